"""One declarative spec per target table.

Most loads share one shape: read a detail table, resolve its owner through the
crosswalk, translate codes and regions to ids, rewrite code lists and
durations, add the audit columns, replace the target.  A :class:`LoadSpec`
names the parts; :func:`build` turns it into a single DataFrame plan with at
most one shuffle for the owner and broadcast joins for the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from remap.functions.dates import duration_parts
from remap.operators.codelists import codes_to_ids, explode_rows
from remap.operators.crosswalk import attach_owner
from remap.operators.lookup import CodeDim, Role, resolve_codes, translate_region
from remap.plans.mapping import AuditBlock, Mapping, map_columns
from remap.session import recording, release
from remap.sinks.loads import LoadResult, append_load, reload_full, reload_truncate


@dataclass(frozen=True)
class OwnerLink:
    """How a detail row finds its owner."""

    owners: DataFrame
    on: str = "old_id"
    how: str = "inner"


@dataclass(frozen=True)
class ListLink:
    """A code list column rewritten as an id list."""

    column: str
    dim: CodeDim
    output: str
    delimiters: str = ";"
    blank: str = "skip"
    form: str = "bare"
    by_id: bool = False


@dataclass
class LoadSpec:
    """Everything needed to fill one target table."""

    target: str
    source: DataFrame
    columns: Mapping
    audit: AuditBlock
    owner: OwnerLink | None = None
    rows_per_code: tuple[str, str] | None = None
    roles: list[Role] = field(default_factory=list)
    regions: dict[str, str] = field(default_factory=dict)
    region_table: CodeDim | None = None
    lists: list[ListLink] = field(default_factory=list)
    durations: dict[str, str] = field(default_factory=dict)
    where: str | Column | None = None
    clear: str = "delete"
    full_audit: bool = False
    ids: bool = False
    id_order: list[Column] | None = None


def build(spec: LoadSpec) -> DataFrame:
    """The rows of the target table as one lazy plan."""
    df = spec.source
    if spec.where is not None:
        df = df.where(spec.where)
    if spec.rows_per_code:
        column, output = spec.rows_per_code
        df = explode_rows(df, column, output=output)
    if spec.owner:
        df = attach_owner(df, spec.owner.owners, on=spec.owner.on, how=spec.owner.how)
    df = resolve_codes(df, spec.roles)
    if spec.regions:
        if spec.region_table is None:
            raise ValueError(f"{spec.target}: regions given without a region table")
        df = translate_region(df, spec.region_table, spec.regions)
    for item in spec.lists:
        df = codes_to_ids(
            df,
            item.column,
            item.dim,
            output=item.output,
            delimiters=item.delimiters,
            blank=item.blank,
            form=item.form,
            by_id=item.by_id,
        )
    for column, prefix in spec.durations.items():
        parts = duration_parts(column)
        df = df.withColumns(
            {f"{prefix}{p}": parts[n] for p, n in (("year", "years"), ("month", "months"), ("day", "days"))}
        )
    audit = spec.audit.columns() if spec.full_audit else spec.audit.short()
    return map_columns(df, [*spec.columns, *audit])


def run(spark: SparkSession, spec: LoadSpec, path: str) -> LoadResult:
    """Build the rows and load them the way the spec clears its target.

    The intermediate tables of the load are deleted when it ends, well or not.
    """
    job = f"load_{spec.target}"
    if spec.clear not in ("append", "delete", "truncate"):
        raise ValueError(f"unknown clear mode: {spec.clear}")
    with recording() as work:
        if spec.clear == "append":
            result = append_load(lambda: build(spec), path, job=job, table=spec.target)
        else:
            load = reload_full if spec.clear == "delete" else reload_truncate
            result = load(
                spark,
                lambda: build(spec),
                path,
                job=job,
                table=spec.target,
                ids=spec.ids,
                id_order=spec.id_order,
            )
    release(spark, work)
    return result
