"""Owner crosswalk queries."""

from __future__ import annotations

from remap.operators.crosswalk import attach_owner, attach_owner_left_inner, crosswalk
from remap.parity.registry import query

_OUT = ["detail_id", "old_id", "owner_id"]


@query(
    "crosswalk_inner",
    """
    SELECT d.detail_id, d.old_id, n.id AS owner_id
    FROM detail_old d
    JOIN party_old o ON d.old_id = o.old_id
    JOIN party_new n ON o.file_no = n.file_no
    """,
)
def _(t):
    return attach_owner(t.detail_old, crosswalk(t.party_old, t.party_new)).select(*_OUT)


@query(
    "crosswalk_left",
    """
    SELECT d.detail_id, d.old_id, x.new_id AS owner_id
    FROM detail_old d
    LEFT JOIN (SELECT o.old_id, n.id AS new_id
               FROM party_old o LEFT JOIN party_new n ON n.file_no = o.file_no) x
      ON d.old_id = x.old_id
    """,
)
def _(t):
    owners = crosswalk(t.party_old, t.party_new, how="left")
    return attach_owner(t.detail_old, owners, how="left").select(*_OUT)


@query(
    "crosswalk_left_inner",
    """
    SELECT d.detail_id, d.old_id, n.id AS owner_id
    FROM detail_old d
    LEFT JOIN party_old o ON d.old_id = o.old_id
    INNER JOIN party_new n ON o.file_no = n.file_no
    """,
)
def _(t):
    return attach_owner_left_inner(t.detail_old, t.party_old, t.party_new).select(*_OUT)


@query(
    "crosswalk_hinted",
    """
    SELECT d.detail_id, n.id AS owner_id FROM detail_old d
    JOIN party_old o ON o.old_id = d.old_id JOIN party_new n ON n.file_no = o.file_no
    """,
)
def _(t):
    owners = crosswalk(t.party_old, t.party_new)
    return attach_owner(t.detail_old, owners, strategy="shuffle_hash").select("detail_id", "owner_id")
