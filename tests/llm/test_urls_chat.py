"""URL filter and preference formatting."""

from __future__ import annotations

import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from remap.llm.preference import preference_examples, swapped_replies
from remap.llm.queries import BLOCK_GLOBS, SITE_RULES
from remap.llm.url_filter import Automaton, SiteRule, judge_urls

text = st.text(alphabet="ab.é#", max_size=12)
glob = st.text(alphabet="ab.é*?", max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(glob, min_size=1, max_size=30), st.lists(text, min_size=1, max_size=20))
def test_automaton_equals_regular_expressions(globs, texts):
    patterns = [re.compile(fnmatch.translate(g.replace("[", "[[]")), re.S) for g in globs]
    found = Automaton(globs).matches(texts)
    assert [[bool(p.match(t)) for p in patterns] for t in texts] == found.tolist()


def test_automaton_over_many_words_and_long_texts():
    globs = ["x" * 100 + "*y", "*" + "z" * 70, "?" * 130]
    texts = ["x" * 100 + "q" * 50_000 + "y", "a" + "z" * 70, "w" * 130, ""]
    assert Automaton(globs).matches(texts).tolist() == [[True, False, False], [False, True, False], [False, False, True], [False] * 3]
    assert Automaton([]).matches(["a"]).shape == (1, 0)


def test_judged_urls(spark):
    urls = {
        1: ("HTTP://M.Example.NET/en/1?x#y", "m.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        3: ("http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
        4: ("ftp://a.org/fr/?q=/en/", "a.org", "/fr/", "org/fr/", "allow"),
        5: (None, "", "", None, "allow"), 6: ("no scheme.net/", "", "", None, "allow"), 7: ("", "", "", None, "allow"),
        8: ("http://www.ads-track.example.org/en/", "www.ads-track.example.org", "/en/", None, "block"),
        9: ("http://x.io/a://b.net/c", "x.io", "/a://b.net/c", None, "allow"), 10: ("http://x.net", "x.net", "", None, "allow"),
        11: ("http://É.NET/" + "p" * 20000, "É.net", "/" + "p" * 20000, "net/", "block"),
        12: ("http://x.com/.example.net/en/", "x.com", "/.example.net/en/", None, "allow"),
    }
    df = spark.createDataFrame([(k, v[0], "c", "c") for k, v in urls.items()] * 2, "page_id long, url string, host string, id string")
    rows = judge_urls(df, "url", "page_id", SITE_RULES, BLOCK_GLOBS).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["page_id"]][1:]
    assert judge_urls(df.where("false"), "url", "page_id", SITE_RULES).count() == 0
    tie = judge_urls(df, "url", "page_id", [SiteRule("net/", "allow"), SiteRule("net/", "block")]).where("page_id = 2").first()
    assert tie["verdict"] == "allow"


SCHEMA = "pair_id long, turn long, role string, text string, score string"


def test_preference_pairs(spark):
    chosen = [
        (1, 0, "system", "s", ""), (1, 1, "user", "hé", ""), (1, 2, "assistant", "yes", ""), (1, 3, "user", "more", ""), (1, 4, "assistant", "ok", ""),
        (2, 0, "user", None, ""), (2, None, None, "x", ""), (3, 0, "user", "only chosen", ""), (None, 0, "user", "lost", ""),
        (5, 0, "assistant", "", ""), (5, 0, "assistant", "", ""),
    ]
    rejected = [
        (1, 0, "system", "s", ""), (1, 1, "user", "hé", ""), (1, 2, "assistant", "no", ""), (2, 0, "user", "", ""),
        (2, None, "", "x", ""), (4, 0, "user", "only rejected", ""), (5, 0, "assistant", "", ""),
    ]
    got = {r["pair_id"]: r for r in preference_examples(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    one = got[1]
    assert one["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nhé<|end|>\n" and one["prompt_turns"] == 2 and one["differs"]
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_loss"]] == ["yes<|end|>", "ok<|end|>"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_loss"]] == ["no<|end|>"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["prompt_turns"] == 2 and not got[2]["differs"]
    assert got[3]["prompt"] == "" and got[3]["rejected"] == "" and got[4]["chosen"] == ""
    assert got[5]["prompt_turns"] == 1 and got[5]["rejected"] == "" and got[5]["chosen"] != ""
    none = spark.createDataFrame([], SCHEMA)
    assert preference_examples(none, none).count() == 0


def test_swapped_replies(spark):
    turns = [(i, t, r, f"{r}{i}") for i in (1, 2, 5, 9) for t, r in enumerate(("user", "assistant", "user"))] + [(7, 0, "user", "alone")]
    df = spark.createDataFrame(turns, "pair_id long, turn long, role string, text string")
    got = {(r["pair_id"], r["turn"]): r["text"] for r in swapped_replies(df).collect()}
    assert len(got) == len(turns)
    assert [got[i, 1] for i in (1, 2, 5, 9)] == ["assistant2", "assistant5", "assistant9", "assistant1"]
    assert got[1, 0] == "user1" and got[7, 0] == "alone"
    assert swapped_replies(df.where("false")).count() == 0
