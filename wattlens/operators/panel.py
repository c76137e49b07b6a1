"""Reports to the labelled unit panel (segments or hours) and the area sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions import arrays, text
from ..functions.maths import nz
from ..functions.times import FAR_FUTURE, FAR_PAST, hours, hours_between, ts
from ..session import materialise
from ..schema import PANEL_COLUMNS
from .bridging import UNIT, bridge_reports, with_unit_id
from .rows import require
from .overlap import overlap_join
from .segments import CHUNK, covered, n_hours, to_hours
from .timeline import interval_sums

SEG = [UNIT, CHUNK, "seg_start", "seg_end"]
EPS = 1e-9


@dataclass(frozen=True)
class PanelOptions:
    max_outage_gap: float = 8
    max_deration_gap: float = 0
    same_type: bool = False
    same_reason: bool = False
    hard_split_forced: bool = True
    cluster_delta: float = 8
    reason_policy: str = "inferred"
    reactive_extension: bool = True
    tie: str = "lowest"
    round_relative: int | None = 3


def state(installed: Column, avail: Column) -> Column:
    """out | derate | avail; a missing availability is full."""
    inst = F.coalesce(installed, F.lit(0.0))
    av = F.coalesce(avail, inst)
    return (
        F.when((inst > 0) & (av <= 0), "out").when((inst > 0) & (av > 0) & (av < inst), "derate").otherwise("avail")
    )


# Bits that tell a report's kind, and below how it stands to a segment.
PLANNED, FORCED, FORCED_LABEL, OBSERVED_MAINT, INFERRED_MAINT, BRIDGE, REACTIVE, REACTIVE_INC, SHORT, LATE = (1 << i for i in range(10))
IN_A, IN_C, BASE, BASE_C, BASE_NOW, FORCED_NOW, PLANNED_NOW, LOWEST, EXTENSION = (1 << i for i in range(10, 19))
SETS = {"base": BASE_NOW, "cand": FORCED_NOW, "plan": PLANNED_NOW, "low": LOWEST}


def _has(bit: int, column: str = "m") -> Column:
    return F.col(column).bitwiseAND(F.lit(bit)) != 0


def _bits(conditions: dict[int, Column]) -> Column:
    out = F.lit(0)
    for bit, c in conditions.items():
        out = out + F.when(c, bit).otherwise(0)
    return out


def narrow(work: DataFrame) -> DataFrame:
    """The columns of reports that capacity and attribution need: times, two numbers, the id
    and a word of bits."""
    doc = F.coalesce("document_sort_time", "created_doc")
    kind = text.outage_type_norm("outage_type")
    return work.select(
        UNIT, "start_out", "end_out", "start_derate", "end_derate", F.col("mrid").alias("id"), F.coalesce("document_sort_time", ts(FAR_FUTURE)).alias("o_doc"),
        F.col("created_doc").alias("created"), F.col("avail_capacity").alias("avail"), F.col("installed_capacity").alias("installed"), "linked_start",
        # currency rank: newest known document; without any, the latest window start
        F.coalesce(doc, ts(FAR_PAST)).alias("rank_d"), F.when(doc.isNull(), F.col("start_derate")).otherwise(ts(FAR_PAST)).alias("rank_s"),
        _bits({PLANNED: kind == "planned", FORCED: kind == "forced", FORCED_LABEL: F.lower(F.coalesce("outage_type", F.lit(""))) == "forced",
               OBSERVED_MAINT: text.reason_class("reason") == "maintenance", INFERRED_MAINT: _inferred_reason() == "maintenance",
               BRIDGE: F.col("is_deration_gap_bridge"), REACTIVE: F.col("reactive"), REACTIVE_INC: F.col("reactive_increment"), SHORT: F.col("short"),
               LATE: F.col("created_doc") > F.col("start_out")}).alias("bits"))


NARROW = ["start_out", "end_out", "start_derate", "end_derate", "id", "o_doc", "created", "avail", "installed", "linked_start", "rank_d", "rank_s", "bits"]


def by_segment() -> WindowSpec:
    """A segment lies in one month, and its rows stay where ``covered`` has dealt the month."""
    return Window.partitionBy(UNIT, CHUNK, "seg_start")


def _newest(tie: str) -> list[Column]:
    """Aggregates over a segment's rows, which carry the newest document times ``nc``, ``na``:
    installed capacity of the first newest outage, available capacity of the newest derations."""
    first = F.min(F.when(F.col("in_c") & (F.col("o_doc") == F.col("nc")), F.struct(
        "start_out", "id", "start_derate", "end_derate", "end_out", "created", "avail", "installed")))
    values = F.when(F.col("in_a") & (F.col("o_doc") == F.col("na")), F.col("avail"))
    return [first["installed"].alias("inst0"), (F.min(values) if tie == "lowest" else F.max(values)).alias("av0")]


def _marked_newest(rows: DataFrame) -> DataFrame:
    newest = lambda c: F.max(F.when(F.col(c), F.col("o_doc"))).over(by_segment())
    return rows.withColumns({"nc": newest("in_c"), "na": newest("in_a")})


def segment_capacity(rows: DataFrame, opts: PanelOptions) -> DataFrame:
    """Capacities and state per segment from the rows of ``covered``."""
    return with_capacity(_marked_newest(rows).groupBy(*SEG).agg(*_newest(opts.tie)), opts)


def with_capacity(df: DataFrame, opts: PanelOptions = PanelOptions()) -> DataFrame:
    """Installed and available capacity, relative availability and state per segment.

    The newest document wins (a missing document time counts as newest, and a newest
    report without a capacity leaves the hour fully available). Installed capacity comes
    from outage windows, first report in reading order on ties, and is filled backwards,
    then forwards, over the unit's series; available capacity uses the tie rule.
    """
    require(opts.tie, ("lowest", "highest"), "tie")
    # a unit's segments number at most one per hour of the horizon (plus chunk starts)
    # running frames in both directions: linear, unlike a frame that shrinks towards the end
    run = lambda o: Window.partitionBy(UNIT).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    back = F.last("inst0", ignorenulls=True).over(run(F.desc("seg_start")))
    fwd = F.last("inst0", ignorenulls=True).over(run(F.asc("seg_start")))
    out = df.withColumn("_back", back).withColumn("installed_capacity", F.coalesce("_back", fwd))
    out = out.withColumn("avail_capacity", F.coalesce("av0", "installed_capacity")).drop("inst0", "av0", "_back")
    rel = F.when(F.col("installed_capacity") > 0, F.col("avail_capacity") / F.col("installed_capacity"))
    if opts.round_relative is not None:
        rel = F.round(rel, opts.round_relative)
    return (
        out.withColumn("relative_avail_capacity", rel)
        .withColumn("state", state(F.col("installed_capacity"), F.col("avail_capacity")))
        .withColumn("total_derate_mw", F.greatest(
            nz("installed_capacity") - F.coalesce("avail_capacity", "installed_capacity", F.lit(0.0)), F.lit(0.0)))
    )


def _inferred_reason() -> Column:
    observed = text.reason_class("reason")
    planned_long = (
        (text.outage_type_norm("outage_type") == "planned")
        & (hours_between("created_doc", "start_derate") >= 7 * 24)
        & (hours_between("start_derate", "end_derate") >= 24)
    )
    return F.when(F.coalesce(planned_long, F.lit(False)), "maintenance").otherwise(observed)


def _ids(a: Column) -> Column:
    return arrays.join_ids(F.transform(a, lambda x: x["id"]))


def forced_increment_events(rows: DataFrame, segs: DataFrame, delta: float) -> DataFrame:
    """(unit, id) of forced reports that cut below the planned baseline known ``delta`` hours ahead.

    ``rows``: segments with their reports; ``segs``: the segments' capacities. Planned reports
    and forced thresholds go on one time line per segment; the baseline known at a threshold is
    the running best of the planned rows before it.
    """
    planned, forced = _has(PLANNED, "bits"), _has(FORCED, "bits")
    line = rows.filter(F.col("in_a") & (planned | forced)).select(
        UNIT, CHUNK, "seg_start", forced.alias("forced"), "id", "avail",
        F.when(planned, F.col("created")).otherwise(F.col("start_out") - hours(delta)).alias("at"),
        F.when(planned, F.struct(F.col("rank_d").alias("d"), F.col("rank_s").alias("s"), F.col("avail").isNotNull().alias("h"), (-F.col("avail")).alias("k"))).alias("plan"),
    ).filter(F.col("at").isNotNull())
    w = by_segment().orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    known = line.withColumn("best", F.max("plan").over(w)).filter("forced").join(segs.select(UNIT, "seg_start", "installed_capacity"), [UNIT, "seg_start"])
    base = F.when(F.col("best").isNull(), F.col("installed_capacity")).otherwise(-F.col("best.k"))
    return known.filter(F.col("avail") < base - EPS).select(UNIT, "id").distinct()


def planned_links(work: DataFrame, increments: DataFrame | None, delta: float) -> DataFrame:
    """Per planned window: is it reactive to, or short notice before, a forced report?

    Forced reports are first reduced to one row per (unit, start, first start of the id), and
    planned ones to distinct windows, so the range join compares compressed sides.
    """
    typ = text.outage_type_norm("outage_type")
    forced = work.filter(typ == "forced").select(UNIT, F.col("mrid").alias("id"), "start_out", "end_out")
    id_start = forced.groupBy(UNIT, "id").agg(F.max("start_out").alias("id_start"))
    forced = forced.join(id_start, [UNIT, "id"])
    if increments is not None:
        forced = forced.join(increments.withColumn("inc", F.lit(True)), [UNIT, "id"], "left")
    else:
        forced = forced.withColumn("inc", F.lit(False))
    f = forced.groupBy(UNIT, F.col("start_out").alias("f_start"), "id_start").agg(
        F.max("end_out").alias("f_end"), F.max(F.when(F.col("inc"), F.col("end_out"))).alias("f_end_inc"))
    f = f.withColumn("w0", F.col("f_start") - hours(delta)).withColumn("w1", F.col("f_end") + hours(delta + 1))
    f = f.select(UNIT, "f_start", "id_start", "f_end", "f_end_inc", "w0", "w1")
    key = [UNIT, "start_out", "end_out", "created_doc"]
    p = work.filter((typ == "planned") & F.col("created_doc").isNotNull()).select(*key).distinct()
    p = p.withColumn("p_end1", F.col("end_out") + F.expr("INTERVAL 1 HOUR"))
    near = (
        (F.col("start_out") <= F.col("f_end") + hours(delta)) & (F.col("end_out") >= F.col("f_start") - hours(delta))
        & (F.col("created_doc") > F.col("f_start") - hours(delta))
    )
    met = overlap_join(p, f, [UNIT], ("start_out", "p_end1"), ("w0", "w1"), where=near)
    after = F.col("created_doc") > F.col("f_start")
    return met.groupBy(*key).agg(
        F.max(after).alias("reactive"),
        F.max(after & F.coalesce(F.col("start_out") <= F.col("f_end_inc") + hours(delta), F.lit(False))).alias("reactive_increment"),
        F.min(F.when(after, F.col("id_start"))).alias("linked_start"),
        F.max(~after).alias("short"),
    )


def link_planned(work: DataFrame, increments: DataFrame | None, delta: float) -> DataFrame:
    """``work`` with the link flags of its planned reports."""
    planned = text.outage_type_norm("outage_type") == "planned"
    links = materialise(planned_links(work, increments, delta)).withColumn("_p", F.lit(True))
    out = work.withColumn("_p", planned).join(links, [UNIT, "start_out", "end_out", "created_doc", "_p"], "left").drop("_p")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("reactive", "reactive_increment", "short")})


def unlinked(work: DataFrame) -> DataFrame:
    off = {c: F.lit(False) for c in ("reactive", "reactive_increment", "short")}
    return work.withColumns({**off, "linked_start": F.lit(None).cast("timestamp")})


def related(rows: DataFrame, opts: PanelOptions = PanelOptions()) -> DataFrame:
    """Each report of a segment with how it stands to it: a word of bits ``m``.

    Two windows over the segment's rows: first the newest documents, the forced threshold and
    the best ranks that need nothing else, then the best rank of the planned baseline, which
    needs the threshold. Of equal ranks the lowest capacity counts.
    """
    planned, forced, reactive = _has(PLANNED, "bits"), _has(FORCED, "bits"), _has(REACTIVE, "bits")
    in_a, in_c = F.col("in_a"), F.col("in_c")
    extension = in_a & planned & reactive & _has(REACTIVE_INC, "bits") if opts.reactive_extension else F.lit(False)
    best = lambda c: F.max(F.when(c, F.struct(F.col("rank_d").alias("d"), F.col("rank_s").alias("s"), F.col("avail").isNotNull().alias("h"),
                                              (-F.col("avail")).alias("k")))).over(by_segment())
    now = lambda key: F.coalesce((F.col("rank_d") == F.col(f"{key}.d")) & (F.col("rank_s") == F.col(f"{key}.s")) & (F.col("avail") == -F.col(f"{key}.k")), F.lit(False))
    rows = _marked_newest(rows).withColumns({
        "threshold": F.min(F.when(in_a & forced, F.col("start_out")).when(extension, F.col("linked_start"))).over(by_segment()),
        "cand_key": best((in_a & forced) | extension), "plan_key": best(in_a & planned),
        "low": F.min(F.when(in_a, F.col("avail"))).over(by_segment())})
    ahead = F.when(F.col("threshold").isNull(), F.lit(True)).otherwise(
        F.coalesce(~reactive & (F.col("created") <= F.col("threshold") - hours(opts.cluster_delta)), F.lit(False)))
    rows = rows.withColumn("ahead", planned & ahead)
    base = in_a & F.col("ahead")
    rows = rows.withColumn("base_key", best(base))
    return rows.withColumn("m", F.coalesce(F.col("bits"), F.lit(0)) + _bits({
        IN_A: in_a, IN_C: in_c, BASE: base, BASE_C: in_c & F.col("ahead"), BASE_NOW: base & now("base_key"),
        FORCED_NOW: ((in_a & forced) | extension) & now("cand_key"), PLANNED_NOW: in_a & planned & now("plan_key"),
        LOWEST: in_a & (F.col("avail") == F.col("low")), EXTENSION: extension}))


def reduced(rows: DataFrame, opts: PanelOptions = PanelOptions()) -> DataFrame:
    """One row per segment: capacities, what is true of any of its reports, sizes of the report
    sets, the bits of the first report among the lowest, and ``members``, the ids in reading order
    with their bits. The ids are output; without the id columns no list is built."""
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    of = lambda *bits: F.col("m").bitwiseAND(F.lit(sum(bits))) == sum(bits)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = []
    for name, bit in SETS.items():
        counts += [n(of(bit)).alias(f"n_{name}"), n(of(bit, OBSERVED_MAINT)).alias(f"obs_{name}"), n(of(bit, INFERRED_MAINT)).alias(f"inf_{name}")]
    read = F.struct("start_out", "o_doc", "id", "start_derate", "end_derate", "end_out", "m")
    member = F.when(F.col("in_a") | F.col("in_c"), read)
    starts_here = _has(FORCED_LABEL) & ((F.col("in_c") & (F.col("start_out") == F.col("seg_start"))) | (F.col("in_a") & (F.col("start_derate") == F.col("seg_start"))))
    return related(rows, opts).groupBy(*SEG).agg(
        *_newest(opts.tie), *counts, any_(F.col("in_a")).alias("any_a"), any_(of(IN_A, FORCED)).alias("any_forced"), any_(of(EXTENSION)).alias("any_extension"),
        any_(of(IN_A, PLANNED, REACTIVE)).alias("any_reactive_a"), any_(of(IN_C, PLANNED, REACTIVE)).alias("any_reactive_c"),
        any_(of(IN_A, BRIDGE)).alias("is_deration_gap_bridge"), any_(of(IN_C, LATE)).alias("any_late"), any_(of(IN_C, PLANNED, SHORT)).alias("any_short"),
        any_(starts_here).alias("forced_start_here"),
        (-F.max("base_key")["k"]).alias("base_avail"), (-F.max("cand_key")["k"]).alias("cand_avail"), F.min(F.when(of(LOWEST), read))["m"].alias("first_low"),
        F.sort_array(F.collect_list(member)).alias("members"))


def attribute(df: DataFrame, opts: PanelOptions = PanelOptions()) -> DataFrame:
    """Rule-based planned/forced attribution of reduced segments with their capacities."""
    require(opts.reason_policy, ("inferred", "reported"), "reason_policy")
    inst = nz("installed_capacity")
    df = df.withColumn("on", F.col("any_a") & (F.col("state") != "avail")).withColumn("base_av", F.coalesce("base_avail", inst))
    df = df.withColumn("inc", F.when(F.col("on"), F.least(
        F.greatest(F.coalesce(F.col("base_av") - F.col("cand_avail"), F.lit(0.0)), F.lit(0.0)), F.col("total_derate_mw"))).otherwise(0.0))
    df = df.withColumn("sched", F.when(F.col("on"), F.least(
        F.greatest(inst - F.col("base_av"), F.lit(0.0)), F.greatest(F.col("total_derate_mw") - F.col("inc"), F.lit(0.0)))).otherwise(0.0))
    by_force, by_plan = F.col("on") & (F.col("inc") > EPS), F.col("on") & (F.col("sched") > EPS)
    by_any = F.col("on") & (F.col("total_derate_mw") > EPS)
    name = F.when(by_force, "cand").when(by_plan, F.when(F.col("n_base") > 0, "base").otherwise("plan")).when(by_any, "low")
    df = df.withColumn("dom_name", name)
    chosen = lambda prefix: F.coalesce(*[F.when(F.col("dom_name") == k, F.col(f"{prefix}_{k}")) for k in SETS], F.lit(0))
    bit = F.coalesce(*[F.when(F.col("dom_name") == k, F.lit(b)) for k, b in SETS.items()], F.lit(0))
    df = df.withColumns({"dom_bit": bit, "n_dom": chosen("n"), "obs_dom": chosen("obs"), "inf_dom": chosen("inf")})
    df = df.withColumn("dom", F.filter("members", lambda x: x["m"].bitwiseAND(F.col("dom_bit")) != 0))
    title = lambda m: F.when(m.bitwiseAND(F.lit(PLANNED)) != 0, "Planned").when(m.bitwiseAND(F.lit(FORCED)) != 0, "Forced")
    some = F.col("n_dom") > 0
    df = df.withColumn("dom_type", F.when(by_force, "Forced").when(by_plan, "Planned").when(by_any & some, title(F.col("first_low"))))
    ext = F.lit(opts.reactive_extension)
    rule = (
        F.when(by_force, F.when(F.col("any_extension") & ~F.col("any_forced"), "reactive_planned_after_forced_increment").otherwise("forced_increment_over_planned"))
        .when(by_plan, F.when(~F.col("any_forced") & F.col("any_reactive_a") & ext, "planned_sequence_reactive_no_forced_increment").otherwise("planned_baseline"))
        .when(by_any, "active_derate_no_baseline").otherwise("")
    )
    warn = F.array(F.when(F.col("any_late"), "reported_after_start"), F.when(F.col("any_short"), "short_notice_planned"),
                   F.when(F.col("any_reactive_c"), "reactive_planned"), F.when(F.col("any_forced") & (F.col("inc") <= EPS), "forced_without_increment"))
    blank = lambda cond, v: F.when(cond, v).otherwise("")
    mode = lambda part, of: F.when(F.col(of) > 0, F.when(F.col(part) * 2 >= F.col(of), "maintenance").otherwise("other"))
    base_maint = (F.col("n_base") > 0) & (F.col("inf_base") * 2 >= F.col("n_base"))
    dom_inf = mode("inf_dom", "n_dom")
    amount = lambda p, v: F.when(p, F.col(v)).otherwise(0.0)
    held = lambda *bits: F.filter("members", lambda x: x["m"].bitwiseAND(F.lit(sum(bits))) == sum(bits))
    id_set = lambda x: F.transform(x, lambda e: e["id"])
    a, reactive_c = held(IN_A), held(IN_C, PLANNED, REACTIVE)
    suppressed = F.array_sort(F.array_except(id_set(a), F.concat(id_set(held(BASE)), id_set(F.col("dom")), id_set(reactive_c))))
    dom_ids = F.when(F.col("on"), _ids(F.col("dom")))
    titled = F.filter(F.transform("dom", lambda x: title(x["m"])), lambda x: x.isNotNull())
    return df.select(
        *SEG, "installed_capacity", "avail_capacity", "relative_avail_capacity", "state", "total_derate_mw",
        _ids(a).alias("active_event_ids"), _ids(held(IN_C)).alias("active_outage_event_ids"),
        _ids(a).alias("active_deration_event_ids"),
        blank(F.col("is_deration_gap_bridge"), _ids(held(IN_A, BRIDGE))).alias("active_deration_gap_bridge_event_ids"),
        "is_deration_gap_bridge",
        blank(F.col("on"), _ids(held(BASE_C))).alias("baseline_context_event_ids"),
        blank(F.col("on"), _ids(held(BASE))).alias("baseline_event_ids"),
        blank(F.col("on"), dom_ids).alias("dominant_event_ids"),
        blank(F.col("on") & F.col("any_reactive_c"), _ids(reactive_c)).alias("reactive_event_ids"),
        blank(F.col("on"), arrays.join_ids(suppressed)).alias("suppressed_event_ids"),
        F.col("sched").alias("scheduled_loss_mw"), F.col("inc").alias("forced_increment_mw"),
        amount(by_plan & ~base_maint, "sched").alias("derate_mw_planned_other"),
        amount(by_plan & base_maint, "sched").alias("derate_mw_planned_maintenance"),
        amount(by_force & (dom_inf != "maintenance"), "inc").alias("derate_mw_forced_other"),
        amount(by_force & (dom_inf == "maintenance"), "inc").alias("derate_mw_forced_maintenance"),
        F.when(dom_ids != "", dom_ids).alias("dominant_outage_id"),
        F.col("dom_type").alias("dominant_outage_type"), F.col("dom_type").alias("type_effective"),
        F.when(some, arrays.join_ids(titled)).alias("type_observed"),
        mode("obs_dom", "n_dom").alias("dominant_outage_reason"),
        dom_inf.alias("dominant_reason_inferred"),
        rule.alias("cluster_rule"),
        blank(F.col("on"), F.array_join(F.filter(warn, lambda x: x.isNotNull()), "|")).alias("type_warning"),
        "forced_start_here",
    ).withColumns({
        "outage_id": F.col("dominant_outage_id"),
        "outage_type": F.col("type_effective"),
        "outage_reason": F.col("dominant_outage_reason" if opts.reason_policy == "reported" else "dominant_reason_inferred"),
    })


def clusters(df: DataFrame, hard_split_forced: bool = True) -> DataFrame:
    """Cluster ids from changes of the label key, with bounds and duration."""
    w = Window.partitionBy(UNIT).orderBy("seg_start")
    key = F.concat_ws("|", "state", *[F.coalesce(c, F.lit("")) for c in ("type_effective", "outage_reason", "cluster_rule")])
    first = F.lag(F.lit(1)).over(w).isNull()
    change = F.when(first, F.col("state") != "avail").otherwise(F.col("_key") != F.lag("_key").over(w))
    if hard_split_forced:
        change = change | (F.col("forced_start_here") & (F.col("state") != "avail")
                           & F.coalesce(F.lower("outage_type") == "forced", F.lit(False)))
    df = df.withColumn("_key", key).withColumn("_chg", change.cast("int"))
    df = df.withColumn("_run", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    off = F.col("state") == "avail"
    by = Window.partitionBy(UNIT, "_run", "_off")
    df = df.withColumn("_off", off)
    c0, c1 = F.min("seg_start").over(by), F.max("seg_end").over(by)
    return (
        df.withColumn("cluster_id", F.when(off, 0).otherwise(F.col("_run")).cast("int"))
        .withColumn("cluster_start", F.when(~off, c0)).withColumn("cluster_end_excl", F.when(~off, c1))
        .withColumn("cluster_duration_h", F.when(off, 0.0).otherwise(hours_between("cluster_start", "cluster_end_excl")))
        .drop("_key", "_chg", "_run", "_off", "forced_start_here")
    )


UNIT_ATTRIBUTES = ["unit_name", "country", "area", "area_type", "plant_type", "plant_type_code"]


def unit_attributes(reports: DataFrame) -> DataFrame:
    """Attributes of a unit series, taken from its first report."""
    first = F.min(F.struct("start_out", "mrid", "document_sort_time", *[F.col(c) for c in UNIT_ATTRIBUTES if c in reports.columns]))
    g = reports.groupBy(UNIT, "area_code", "asset_type", F.col("unit_eic").alias("eic_code")).agg(first.alias("f"))
    return g.select(UNIT, "area_code", "asset_type", "eic_code",
                    *[(F.col(f"f.{c}") if c in reports.columns else F.lit(None).cast("string")).alias(c) for c in UNIT_ATTRIBUTES])


# What ``narrow`` and ``link_planned`` read.
WORK = [UNIT, "mrid", "start_out", "end_out", "start_derate", "end_derate", "document_sort_time", "created_doc", "avail_capacity", "installed_capacity",
        "outage_type", "reason", "is_deration_gap_bridge"]


def _bridged(clean: DataFrame, opts: PanelOptions) -> tuple[DataFrame, DataFrame]:
    """Bridged reports without their unit's attributes, and the attributes. Rows that close gaps
    between derations count among the reports that attributes are taken from."""
    work = bridge_reports(clean, opts.max_outage_gap, opts.max_deration_gap, opts.same_type, opts.same_reason, opts.tie)
    if opts.max_deration_gap > 0:
        work = materialise(work)
        return work, unit_attributes(work)
    return materialise(work.select(*WORK)), unit_attributes(with_unit_id(clean))


def build_segments(clean: DataFrame, start: str, end: str, opts: PanelOptions = PanelOptions()) -> DataFrame:
    """The labelled panel in interval form: unit attributes, ``seg_start``, ``seg_end``, labels."""
    require(opts.tie, ("lowest", "highest"), "tie")
    work, attributes = _bridged(clean, opts)
    increments = None
    if opts.reactive_extension:
        first = materialise(covered(narrow(unlinked(work)), start, end, NARROW))
        increments = forced_increment_events(first, segment_capacity(first, opts), opts.cluster_delta)
    linked = materialise(narrow(link_planned(work, increments, opts.cluster_delta)))
    rows = covered(linked, start, end, NARROW)
    labelled = clusters(attribute(with_capacity(reduced(rows, opts), opts), opts), opts.hard_split_forced)
    return attributes.join(labelled, UNIT)


def capacity_segments(clean: DataFrame, start: str, end: str, opts: PanelOptions = PanelOptions()) -> DataFrame:
    """Capacities and state only, without attribution."""
    work, attributes = _bridged(clean, opts)
    rows = covered(narrow(unlinked(work)), start, end, NARROW)
    return attributes.join(segment_capacity(rows, opts), UNIT)


def build_panel(clean: DataFrame, start: str, end: str, opts: PanelOptions = PanelOptions()) -> DataFrame:
    """The labelled panel with one row per unit-hour and the export columns."""
    return to_hours(build_segments(clean, start, end, opts)).select(*PANEL_COLUMNS)


RULE_COLUMNS = ["derate_mw_planned_other", "derate_mw_planned_maintenance", "derate_mw_forced_other",
                "derate_mw_forced_maintenance"]


def outage_parts(df: DataFrame, missing_is_full: bool = False, use_rules: bool = True) -> dict[str, Column]:
    """MW parts per row: rule columns when present, else by the dominant label."""
    cols = set(df.columns)
    inst = nz("installed_capacity")
    raw_av = F.col("avail_capacity") if "avail_capacity" in cols else F.col("installed_capacity") * F.col("relative_avail_capacity")
    av = F.coalesce(raw_av, inst) if missing_is_full else raw_av
    outage = F.least(F.greatest(F.coalesce(inst - av, F.lit(0.0)), F.lit(0.0)), inst)
    parts = {"outage": outage, "installed": inst}
    if use_rules and set(RULE_COLUMNS) <= cols:
        po, pm, fo, fm = (nz(c) for c in RULE_COLUMNS)
        parts |= {"planned": po + pm, "forced": fo + fm, "maintenance": pm + fm,
                  "forced_nonmaintenance": fo, "planned_nonmaintenance": po}
    else:
        low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
        p, f_, m = low("outage_type") == "planned", low("outage_type") == "forced", low("outage_reason") == "maintenance"
        when = lambda cond: F.when(cond, outage).otherwise(0.0)
        parts |= {"planned": when(p), "forced": when(f_), "maintenance": when(m),
                  "forced_nonmaintenance": when(f_ & ~m), "planned_nonmaintenance": when(p & ~m)}
    return parts


SUM_PARTS = ["planned", "forced", "maintenance", "forced_nonmaintenance", "planned_nonmaintenance"]


def outage_sum_intervals(segments: DataFrame, missing_is_full: bool = False) -> DataFrame:
    """Outage MW and unit counts per country, area and plant type, as intervals in which they
    are constant: prefix sums over interval bounds, no hourly rows.

    Units are counted as a sum of flags; only a unit that appears as several series of one group
    is summed up by itself first.
    """
    keys = ["country", "area", "plant_type_code"]
    parts = outage_parts(segments, missing_is_full)
    unit = F.concat(F.coalesce(F.col("asset_type"), F.lit("UNKNOWN")), F.lit("|"), F.col("eic_code"))
    rows = segments.filter(F.col("country").isNotNull() & F.col("area").isNotNull() & F.col("plant_type_code").isNotNull())
    rows = rows.select(*keys, UNIT, unit.alias("u"), "seg_start", "seg_end", *[v.alias(k) for k, v in parts.items()])
    multi = rows.groupBy(*keys, "u").agg(F.min(UNIT).alias("x"), F.max(UNIT).alias("y")).filter("x <> y").select(
        *keys, "u", F.lit(True).alias("multi"))
    rows = rows.join(multi, [*keys, "u"], "left")
    names = ["outage", *SUM_PARTS]
    both = [*keys, "seg_start", "seg_end", "installed", *names]
    shared = interval_sums(rows.filter(F.col("multi").isNotNull()), [*keys, "u"], {n: F.col(n) for n in ("installed", *names)})
    units = rows.filter(F.col("multi").isNull()).select(*both).unionByName(shared.select(*both))
    flags = {f"n_{n}": (F.col(n) > 0).cast("long") for n in names}
    sums = interval_sums(units, keys, {**{n: F.col(n) for n in ("installed", *names)}, **flags}, count="n_total")
    mw = lambda n: "sum_outage_mw" if n == "outage" else f"sum_outage_mw_{n}"
    return sums.select(*keys, "seg_start", "seg_end", F.col("installed").alias("sum_installed_capacity_mw"), F.col("n_total").alias("count_units_total"),
                       *[F.col(n).alias(mw(n)) for n in names], *[F.col(f"n_{n}").alias(f"count_units_{n}") for n in names])


def outage_sums(segments: DataFrame, missing_is_full: bool = False) -> DataFrame:
    """``outage_sum_intervals`` with one row per hour: group-hours only, whatever the units."""
    return to_hours(outage_sum_intervals(segments, missing_is_full))


__all__ = ["PanelOptions", "attribute", "build_panel", "build_segments", "capacity_segments", "clusters",
           "outage_parts", "outage_sum_intervals", "outage_sums", "state", "n_hours"]
