"""Code-to-id lookups against small code tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remap.functions.text import code_text, empty_to_null, key_text, strip_prefix
from remap.operators.sizing import (
    DEFAULT_LIMIT,
    BroadcastLimit,
    broadcast_if_small,
    row_bytes,
)
from remap.session import keep, materialize


# Bytes all broadcasts of one star may take together on every executor.
STAR_BUDGET = 512 * 1024 * 1024


class DuplicateCode(ValueError):
    """A code table holds one code more than once."""


@dataclass
class CodeDim:
    """A code table prepared once and joined under any number of roles.

    ``deleted`` says how the soft-delete flag counts: ``strict`` wants 0,
    ``lenient`` reads NULL as 0, ``ignore`` keeps every row.  ``normalise``
    compares codes as trimmed text.  ``duplicates`` is ``error`` (checked
    before the first join), ``first`` (lowest ``order`` wins) or ``all`` (every
    match multiplies the row, as a plain outer join does).
    """

    frame: DataFrame
    code: str = "code"
    values: tuple[str, ...] = ("id",)
    deleted: str = "ignore"
    deleted_column: str = "is_deleted"
    normalise: bool = False
    duplicates: str = "error"
    order: str | None = None
    limit: BroadcastLimit = DEFAULT_LIMIT
    _prepared: DataFrame | None = field(default=None, repr=False)
    _rows: int = field(default=0, repr=False)
    _size: int = field(default=0, repr=False)
    _hashed: bool = field(default=False, repr=False)

    def key(self, c: Column | str) -> Column:
        """Code as stored in the prepared table: text, empty as NULL."""
        text = self._code(c)
        return key_text(text) if self.normalise else empty_to_null(text)

    def probe(self, c: Column | str) -> Column:
        """Code on the looked-up side.  No stored code is empty, so an empty one
        needs no NULL test to miss."""
        text = self._code(c)
        return F.trim(text) if self.normalise else text

    def _code(self, c: Column | str) -> Column:
        return code_text(F.col(c) if isinstance(c, str) else c)

    def live(self) -> DataFrame:
        """Rows the soft-delete rule keeps."""
        if self.deleted == "strict":
            return self.frame.where(F.col(self.deleted_column) == 0)
        if self.deleted == "lenient":
            return self.frame.where(F.coalesce(F.col(self.deleted_column), F.lit(0)) == 0)
        if self.deleted == "ignore":
            return self.frame
        raise ValueError(f"unknown soft-delete rule: {self.deleted}")

    def table(self) -> DataFrame:
        """``(__code, values...)`` with the duplicate rule applied."""
        if self._prepared is None:
            self._prepare()
        return self._prepared

    def side(self) -> DataFrame:
        """The prepared table, hinted for broadcast where its size allows it."""
        table = self.table()
        return F.broadcast(table) if self.small else table

    @property
    def rows(self) -> int:
        self.table()
        return self._rows

    @property
    def size(self) -> int:
        """Estimated bytes of the prepared table."""
        self.table()
        return self._size

    @property
    def hashed(self) -> bool:
        """True where no two rows share the 64-bit hash of their code."""
        self.table()
        return self._hashed

    @property
    def small(self) -> bool:
        return self.limit.allows(self.rows, self.size)

    def _prepare(self) -> None:
        live = self.live().select(self.key(self.code).alias("__code"), *self.values)
        live = live.where(F.col("__code").isNotNull())
        if self.duplicates == "first":
            order = self.order or self.values[0]
            packed = F.min_by(F.struct(*self.values), F.col(order)).alias("v")
            live = live.groupBy("__code").agg(packed).select("__code", "v.*")
        elif self.duplicates not in ("error", "all"):
            raise ValueError(f"unknown duplicate rule: {self.duplicates}")
        # One pass answers three questions: rows, bytes, most rows on one hash.
        per_hash = live.groupBy(F.xxhash64("__code")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(row_bytes(live)).alias("b")
        )
        rows, size, most = per_hash.agg(
            F.coalesce(F.sum("n"), F.lit(0)),
            F.coalesce(F.sum("b"), F.lit(0)),
            F.coalesce(F.max("n"), F.lit(0)),
        ).first()
        if self.duplicates == "error" and most > 1:
            # Either one code repeats, or (hardly ever) two codes share a hash.
            require_unique_code(live, self.code)
        self._rows, self._size, self._hashed = int(rows), int(size), most <= 1
        if self.duplicates == "first" and not self.limit.allows(rows, size):
            live = keep(materialize(live, "codes"))  # see sizing.settled
        self._prepared = live


@dataclass(frozen=True)
class Role:
    """One use of a code table: which column is looked up and what it yields."""

    column: str | Column
    dim: CodeDim
    output: dict[str, str]
    required: bool = False


def resolve_codes(
    df: DataFrame, roles: list[Role], budget: int = STAR_BUDGET
) -> DataFrame:
    """Star of lookups: one left join per role, inner where ``required``.

    Row count is kept for optional roles on unique codes.  A code table used
    under several roles is broadcast once; Spark reuses the exchange.  All
    broadcasts of one star together stay under ``budget`` bytes: the smallest
    tables go first, the rest are joined by shuffle.

    Broadcast text codes are joined by their 64-bit hash and compared as text
    afterwards: a number key is several times cheaper to look up, and since the
    hashes of a code table are checked to be distinct, the one candidate either
    is the code or there is none.

    An output must not name a column that exists or another role's output.
    """
    taken = list(df.columns)
    for role in roles:
        clash = [o for o in role.output if o in taken]
        if clash or len(set(role.output)) < len(role.output):
            raise ValueError(f"lookup outputs name existing columns: {clash}")
        taken += role.output
    fits = _within_budget([role.dim for role in roles], budget)
    keys = [f"__k{i}" for i in range(len(roles))]
    for key, role in zip(keys, roles):
        code, probe = F.col("__code"), role.dim.probe(role.column)
        fit, hit = id(role.dim) in fits, None
        column = F.col(role.column) if isinstance(role.column, str) else role.column
        side = role.dim.table()
        if isinstance(df.select(column).schema[0].dataType, T.IntegralType):
            # A number equals a code only where the code is that number's text,
            # so both sides can stay numbers: no text is built per row.
            number = code.try_cast("bigint")
            side = side.where(number.cast("string") == code)
            code, probe = number, column.cast("bigint")
        elif fit and role.dim.hashed:
            side, text = side.withColumn(f"{key}t", code), probe
            hit = text == F.col(f"{key}t")
            code, probe = F.xxhash64(code), F.xxhash64(probe)
        extra = [] if hit is None else [f"{key}t"]
        outputs = [F.col(v).alias(o) for o, v in role.output.items()]
        side = side.select(code.alias(key), *extra, *outputs)
        side = F.broadcast(side) if fit else side
        df = df.join(side, probe == side[key], "inner" if role.required else "left")
        if hit is not None and role.required:
            # Not a bare equality, which would become a second (text) join key.
            df = df.where(F.coalesce(hit, F.lit(False)))
        elif hit is not None:
            df = df.withColumns({o: F.when(hit, F.col(o)) for o in role.output})
    return df.drop(*keys, *[f"{key}t" for key in keys])


def require_unique_code(codes: DataFrame, name: str) -> None:
    most = codes.groupBy("__code").count().agg(F.max("count")).first()[0]
    if most > 1:
        raise DuplicateCode(f"column {name!r} repeats a code ({most} rows on one code)")


def _within_budget(dims: list[CodeDim], budget: int) -> set[int]:
    """Ids of the small code tables whose sizes add up to at most ``budget``."""
    distinct = {id(d): d for d in dims if d.small}
    fits, used = set(), 0
    for key, dim in sorted(distinct.items(), key=lambda kv: kv[1].size):
        used += dim.size
        if used <= budget:
            fits.add(key)
    return fits


def region_table(
    mapping: DataFrame,
    regions: DataFrame,
    *,
    old_code: str = "old_code",
    new_code: str = "new_code",
    region_code: str = "code",
    region_id: str = "id",
) -> DataFrame:
    """Collapse old code -> new code -> region id into one small table.

    Every side is compared as trimmed text; regions flagged deleted drop out
    while their mapping stays with a NULL id.
    """
    dim = CodeDim(
        regions, code=region_code, values=(region_id,), deleted="lenient", normalise=True
    )
    out = resolve_codes(mapping, [Role(new_code, dim, {"region_id": region_id})])
    return out.select(
        key_text(old_code).alias("old_code"), key_text(new_code).alias("new_code"), "region_id"
    )


def translate_region(
    df: DataFrame, table: CodeDim, columns: dict[str, str]
) -> DataFrame:
    """Region id for each ``{old code column: output column}``."""
    return resolve_codes(df, [Role(c, table, {out: "region_id"}) for c, out in columns.items()])


def region_dim(table: DataFrame) -> CodeDim:
    """The collapsed region table as a code table for :func:`translate_region`."""
    return CodeDim(table, code="old_code", values=("region_id", "new_code"), normalise=True)


def match_local_name(
    df: DataFrame,
    places: DataFrame,
    *,
    name: str,
    region: str,
    prefixes: list[str],
    output: str,
    place_name: str = "name",
    place_region: str = "region_code",
    place_id: str = "id",
    limit: BroadcastLimit = DEFAULT_LIMIT,
) -> DataFrame:
    """Place id by region and by name without its kind word.

    The kind word is dropped in any letter case; the rest of the name is
    compared exactly, inside the row's own region.
    """
    side = places.select(
        key_text(code_text(F.col(place_region))).alias("__region"),
        strip_prefix(place_name, prefixes).alias("__name"),
        F.col(place_id).alias(output),
    )
    side = broadcast_if_small(side, limit)
    on = (key_text(code_text(F.col(region))) == side["__region"]) & (
        strip_prefix(name, prefixes) == side["__name"]
    )
    return df.join(side, on, "left").drop("__region", "__name")
