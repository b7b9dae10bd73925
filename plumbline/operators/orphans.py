"""References to records that do not exist (problem 6).

Method: every reference is checked against the table it points to; then a fixpoint cascade treats the children of
orphaned records as orphaned too, by semi-joins down the foreign-key graph (any number of tables, several parents of
a record) until no new record is found.

Defined results
* a null reference, or one equal to a `none_values` entry, is no reference;
* `missing`: no row of that key at all; `deleted`: made after the referred row's deletion; `late`: made before the
  referred row was created. A child that is both deleted and late (its parent's times are inverted) is `deleted`;
* repeated child rows count once; of repeated parent rows the earliest creation counts, and the latest deletion,
  but none if one of the rows is not deleted;
* a child without a time can only be missing; its period is null;
* empty tables give an empty report.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage, unstage

REPORT = "child_table string, ref_id bigint, child_no bigint, period_ym string, orphan_kind string, origin string, hops int"


@dataclass(frozen=True)
class Reference:
    """A foreign key: `column` of `child` names `key` of `parent`. `child_key` is set where the children can be
    referred to themselves, so that the cascade goes on through them."""

    child: str
    column: str
    child_no: str
    made_at: str
    parent: str
    key: str = "id"
    created_at: str = "created_at"
    deleted_at: str | None = None
    child_key: str | None = None
    none_values: tuple[int, ...] = ()


#: The references of a project database.
PROJECT_REFERENCES = (
    Reference("point_cloud_data", "cloud_id", "chunk_index", "recorded_at", "point_clouds", deleted_at="deleted_at"),
    Reference("label_definitions", "cloud_id", "label_id", "recorded_at", "point_clouds", deleted_at="deleted_at"),
    Reference("building_components", "parent_id", "id", "created_at", "building_components", child_key="id", none_values=(-1,)),
)


def _children(tables: dict[str, DataFrame], r: Reference) -> DataFrame:
    c = tables[r.child]
    keep = F.col("ref_id").isNotNull() & (~F.col("ref_id").isin(list(r.none_values)) if r.none_values else F.lit(True))
    return c.select(
        F.col(r.column).cast("long").alias("ref_id"), F.col(r.child_no).cast("long").alias("child_no"), F.col(r.made_at).alias("made_at"),
        (F.col(r.child_key).cast("long") if r.child_key else F.lit(None).cast("long")).alias("child_key"),
    ).where(keep)


def _parents(tables: dict[str, DataFrame], r: Reference) -> DataFrame:
    p = tables[r.parent]
    gone = F.col(r.deleted_at) if r.deleted_at else F.lit(None).cast("timestamp_ntz")
    return p.where(F.col(r.key).isNotNull()).groupBy(F.col(r.key).cast("long").alias("ref_id")).agg(
        F.min(r.created_at).alias("created"), F.when(F.count("*") == F.count(gone), F.max(gone)).alias("deleted"), F.lit(True).alias("there"))


def direct_orphans(tables: dict[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """Every child row whose own reference did not hold when it was made. The parents are unique per key, so a hot
    key only makes the child side skewed, which the adaptive skew join splits."""
    out = None
    for r in references:
        kind = (
            F.when(F.col("there").isNull(), "missing").when(F.col("made_at") > F.col("deleted"), "deleted")
            .when(F.col("made_at") < F.col("created"), "late")
        )
        one = (
            _children(tables, r).join(_parents(tables, r), "ref_id", "left").withColumn("orphan_kind", kind).where("orphan_kind is not null")
            .select(F.lit(r.child).alias("child_table"), "ref_id", "child_no", F.date_format("made_at", "yyyy-MM").alias("period_ym"), "orphan_kind", "child_key")
            .distinct()
        )
        out = one if out is None else out.unionByName(one)
    return out


def cascade(tables: dict[str, DataFrame], references: Sequence[Reference] = PROJECT_REFERENCES) -> DataFrame:
    """The report of direct orphans (`origin` direct, hops 0) and of all rows below them (`origin` inherited; `hops` is
    the distance to the nearest direct orphan above; `orphan_kind` that of the reference that broke, the first in
    the alphabet where two breaks are equally near). A direct orphan is not also inherited.

    The references may form any graph of tables, loops included, and a record may have several parents: a row is inherited
    if the record it refers to is an orphan of either origin."""
    direct = stage(direct_orphans(tables, references))
    cols = ["child_table", "ref_id", "child_no", "period_ym", "orphan_kind"]
    out = direct.select(*cols, F.lit("direct").alias("origin"), F.lit(0).alias("hops"))
    number = {n: i for i, n in enumerate(sorted({n for r in references for n in (r.child, r.parent)}))}
    keyed = [r for r in references if r.child_key and any(o.parent == r.child for o in references)]
    if not keyed:
        return out
    links = sick = None
    for r in keyed:
        tab = F.lit(number[r.child]).alias("tab")
        link = _children(tables, r).where("child_key is not null").select(tab, F.col("child_key").alias("key"), F.lit(number[r.parent]).alias("up_tab"), F.col("ref_id").alias("up"))
        root = direct.where((F.col("child_table") == r.child) & F.col("child_key").isNotNull()).select(tab, F.col("child_key").alias("key"), "orphan_kind")
        links, sick = (link, root) if links is None else (links.unionByName(link), sick.unionByName(root))
    state = _nearest(links.distinct(), sick.groupBy("tab", "key").agg(F.min("orphan_kind").alias("orphan_kind")))
    below = None
    for r in references:
        rows = _children(tables, r).join(state.where(F.col("tab") == number[r.parent]).select(F.col("key").alias("ref_id"), "orphan_kind", "hops"), "ref_id").select(
            F.lit(r.child).alias("child_table"), "ref_id", "child_no", F.date_format("made_at", "yyyy-MM").alias("period_ym"), "orphan_kind", F.lit("inherited").alias("origin"), (F.col("hops") + 1).cast("int").alias("hops"))
        below = rows if below is None else below.unionByName(rows)
    return out.unionByName(below.distinct().join(direct.select("child_table", "ref_id", "child_no"), ["child_table", "ref_id", "child_no"], "left_anti").select(*out.columns))


def _nearest(links: DataFrame, sick: DataFrame) -> DataFrame:
    """(tab, key, orphan_kind, hops) of the direct orphans (sick) and of all records that reach one over the links (tab, key, up_tab, up).

    The fixpoint of semi-joins down the links, taken in doubled steps, as chains are hundreds of links long: in round k every record
    not yet decided holds its ancestors 2^k links up; if one is decided, so is the record; else it takes over their ancestors.
    A record without decided or further ancestors is sound and drops out."""
    key = ["tab", "key"]
    found = [stage(sick.select(*key, "orphan_kind", F.lit(0).cast("long").alias("hops")))]
    open_ = stage(links.join(found[0], key, "left_anti"))
    span = 1
    while True:
        known = found[0]
        for more in found[1:]:
            known = known.unionByName(more)
        up = known.select(F.col("tab").alias("up_tab"), F.col("key").alias("up"), F.struct((F.col("hops") + span).alias("hops"), "orphan_kind").alias("got"))
        new = stage(open_.join(up, ["up_tab", "up"]).groupBy(*key).agg(F.min("got").alias("got")).select(*key, "got.orphan_kind", "got.hops"))
        then = open_.select(F.col("tab").alias("up_tab"), F.col("key").alias("up"), F.col("up_tab").alias("next_tab"), F.col("up").alias("next"))
        further = stage(open_.join(new, key, "left_anti").join(then, ["up_tab", "up"]).select(*key, F.col("next_tab").alias("up_tab"), F.col("next").alias("up")).distinct())
        unstage(open_)
        found.append(new)
        open_, span = further, span * 2
        # records farther away have ancestors at every smaller distance, so a round that decides none is the last; this also ends sound loops
        if not new.limit(1).count() or not open_.limit(1).count():
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out
