"""Summaries, keep-best between readings, comparisons and report views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgate.functions.numbers import number_text
from specgate.functions.text import blank_to_null, compact_key, trim_ws
from specgate.operators.pages import OCR_CHARS, PRIMARY_OCR
from specgate.operators.verdict import COLLAPSE_CODES

# How close to a limit counts as near, and the margin that needs no review.
NEAR_SHARE = 0.05
GREEN_MARGIN = 0.30
TRUSTED_GRIDS = ["structural", "scanned-vector"]


def _is(status: str) -> Column:
    return F.col("status") == status


def _key(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def summarize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per report; combined map-side before the shuffle."""
    return rows.groupBy(*keys).agg(
        F.count_if(_is("PASS")).alias("n_pass"), F.count_if(_is("FAIL")).alias("n_fail"),
        F.count_if(_is("SKIP")).alias("n_skip"), F.count(F.lit(1)).alias("n_total"),
        F.count_if("needs_review").alias("n_review"),
    )


def collapse(status: Column, reason_code: Column) -> Column:
    """A SKIP that hints at swapped columns or rows."""
    return (status == "SKIP") & reason_code.isin(COLLAPSE_CODES)


def pass_multiset(rows: DataFrame, keys: list[str]) -> DataFrame:
    """PASS rows per name without white space and case."""
    return rows.where(_is("PASS")).groupBy(*keys, compact_key(F.col("name")).alias("name_key")).agg(
        F.count(F.lit(1)).alias("n_pass")
    )


def challenger_beats(rows: DataFrame, keys: list[str], incumbent: str, challenger: str) -> DataFrame:
    """One row per report; `beats` when the challenger has no FAIL, loses no PASS of any
    name and has more PASS in total. Two aggregations, the second over name counts only."""
    old, new = F.col("variant") == incumbent, F.col("variant") == challenger
    by_name = rows.groupBy(*keys, compact_key(F.col("name")).alias("__n")).agg(
        F.count_if(old & _is("PASS")).alias("__op"), F.count_if(new & _is("PASS")).alias("__np"),
        F.count_if(new & _is("FAIL")).alias("__nf"), F.count_if(old & _is("SKIP")).alias("__os"),
        F.count_if(new).alias("__nn"),
        F.bool_or(old & collapse(F.col("status"), F.col("reason_code"))).alias("__oc"),
    )
    return by_name.groupBy(*keys).agg(
        F.sum("__op").alias("old_pass"), F.sum("__np").alias("new_pass"), F.sum("__nf").alias("new_fail"),
        F.sum("__os").alias("old_skip"), (F.sum("__nn") > 0).alias("has_challenger"),
        F.bool_or("__oc").alias("collapsed"), F.bool_and(F.col("__np") >= F.col("__op")).alias("keeps_all"),
    ).withColumn("beats", (F.col("new_fail") == 0) & F.col("keeps_all") & (F.col("new_pass") > F.col("old_pass")))


def keep_best(
    rows: DataFrame, keys: list[str], incumbent: str, challenger: str, structural: Column | None = None
) -> DataFrame:
    """Rows of the winning reading per report.

    The challenger is allowed where the incumbent shows a collapse symptom, or
    has any SKIP and the grid columns come from ruling lines (`structural`).
    """
    structural = F.lit(False) if structural is None else structural
    d = challenger_beats(rows, keys, incumbent, challenger)
    allowed = F.col("collapsed") | (structural & (F.col("old_skip") > 0))
    d = d.withColumn("winner", F.when(F.col("has_challenger") & allowed & F.col("beats"), challenger).otherwise(incumbent))
    return rows.join(d.select(*keys, F.col("winner").alias("variant")), [*keys, "variant"], "left_semi")


def keep_best_hq(best: DataFrame, second: DataFrame, keys: list[str], pages: DataFrame) -> DataFrame:
    """The winner of a high-quality reading (I5 again, `second`) replaces the best rows of a scanned page, where a SKIP
    may benefit, the second text is long enough to be one, and it beats them. Rows of other pages of `second` are ignored.

    `pages` has engine, has_image and second_chars, the characters of the second text that are not white space.
    """
    rows = best.withColumn("__of", F.lit("best")).unionByName(second.withColumn("__of", F.lit("second")))
    d = challenger_beats(rows.withColumn("variant", F.col("__of")), keys, "best", "second")
    worth = reprocess_queue(best, keys, pages.where(F.col("second_chars") >= OCR_CHARS))
    d = d.join(worth, keys, "left").withColumn("__of", F.when(F.col("n_worth").isNotNull() & F.col("beats"), "second").otherwise("best"))
    return rows.join(d.select(*keys, "__of"), [*keys, "__of"], "left_semi").drop("__of")


def pass_identity() -> list[Column]:
    """What makes two PASS rows the same: name, limits, printed limit and result; numbers are compared as numbers."""
    return [F.lower(trim_ws(F.col("name"))), F.col("min"), F.col("max"), _key(F.col("spec_raw")), F.col("result")]


def near_boundary(lo: Column, hi: Column, value: Column) -> Column:
    """Within 5 % of the range; one-sided, collapsed or unreadable counts as near."""
    span = hi - lo
    return F.when(lo.isNull() | hi.isNull() | value.isNull(), True).otherwise(
        (span <= F.abs(value) * 1e-3) | (value <= lo + span * NEAR_SHARE) | (value >= hi - span * NEAR_SHARE)
    )


def provenance_flags(
    best: DataFrame, incumbent_rows: DataFrame, keys: list[str], challenger: str, structural: Column
) -> DataFrame:
    """A challenger PASS the incumbent does not confirm is reviewed (with ruling lines only near a limit)."""
    ids = [f"__id{i}" for i in range(len(pass_identity()))]
    confirmed = incumbent_rows.where(_is("PASS")).select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c.alias(f"_{i}") for c, i in zip(pass_identity(), ids, strict=True)],
        F.lit(True).alias("__seen")).distinct()
    d = best.withColumns(dict(zip(ids, pass_identity(), strict=True)))
    same = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(i).eqNullSafe(F.col(f"_{i}")) for i in ids]
    d = d.join(confirmed, same, "left")
    doubt = (F.col("variant") == challenger) & _is("PASS") & F.col("__seen").isNull() & (
        ~structural | near_boundary(F.col("min"), F.col("max"), F.col("result"))
    )
    return d.withColumn("needs_review", F.col("needs_review") | doubt).drop("__seen", *ids, *[f"_{i}" for i in ids], *[f"__{k}" for k in keys])


def carry_header(winner: DataFrame, incumbent: DataFrame, keys: list[str]) -> DataFrame:
    """Product and lot of the incumbent where the winner has none."""
    old = incumbent.select(*keys, F.col("product").alias("__p"), F.col("lot_no").alias("__l"))
    return winner.join(old, keys, "left").withColumns({
        "product": F.coalesce(blank_to_null(F.col("product")), F.col("__p")),
        "lot_no": F.coalesce(blank_to_null(F.col("lot_no")), F.col("__l")),
    }).drop("__p", "__l")


def may_benefit() -> Column:
    """A SKIP a better reading could mend: a side is missing or carries a digit."""
    spec = F.coalesce(blank_to_null(F.col("spec_raw")), number_text(F.coalesce("min", "max")))
    res = F.coalesce(blank_to_null(F.col("result_raw")), number_text(F.col("result")))
    return _is("SKIP") & (spec.isNull() | res.isNull() | spec.rlike(r"\d") | res.rlike(r"\d"))


def reprocess_queue(rows: DataFrame, keys: list[str], pages: DataFrame) -> DataFrame:
    """I8: scanned pages with an image to read again, and the number of their rows that may benefit.

    `pages` has engine and has_image per report."""
    scanned = pages.where((F.col("engine") == PRIMARY_OCR) & F.col("has_image")).select(*keys).distinct()
    return rows.where(may_benefit()).join(scanned, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_worth"))


def report_verdict(summary: DataFrame, lot_no: Column, page: Column, pages_in_file: Column) -> DataFrame:
    """Clean / warn / fail and the label of the report."""
    sound = (F.col("n_fail") == 0) & (F.col("n_total") > 0)
    return summary.withColumns({
        "verdict": F.when(sound & (F.col("n_review") == 0), "clean").when(sound, "warn").otherwise("fail"),
        "label": F.when(pages_in_file > 1, F.coalesce(F.concat(F.lit("Lot "), blank_to_null(lot_no)),
                                                      F.concat(F.lit("Page "), page.cast("string")))),
    })


def status_share(summary: DataFrame) -> DataFrame:
    """Bar widths in percent; empty FAIL and SKIP bars keep 4 %."""
    total = F.greatest(F.col("n_total"), F.lit(1))

    def pct(c: str) -> Column:
        return F.col(c) / total * 100

    return summary.withColumns({
        "pass_pct": pct("n_pass"),
        "fail_pct": F.when(F.col("n_fail") == 0, 4.0).otherwise(pct("n_fail")),
        "skip_pct": F.when(F.col("n_skip") == 0, 4.0).otherwise(pct("n_skip")),
    })


def batch_metrics(rows: DataFrame, file_key: str) -> DataFrame:
    """Per file and for the whole batch (file null)."""
    return rows.rollup(file_key).agg(
        F.count_if(_is("PASS")).alias("n_pass"), F.count_if(_is("FAIL")).alias("n_fail"),
        F.count_if(_is("SKIP")).alias("n_skip"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if("needs_review").alias("n_review"),
        F.floor((F.count_if(~_is("SKIP")) / F.count(F.lit(1))) * 100 + 0.5).cast("bigint").alias("verdict_rate"),
    )


def fail_listing(rows: DataFrame) -> DataFrame:
    return rows.where(_is("FAIL"))


def compare_models(rows: DataFrame, file_key: str, model: str, models: list[str]) -> DataFrame:
    """P/F/S per file and model side by side, plus the total row (file null)."""
    counts = rows.groupBy(file_key, model).agg(
        F.count_if(_is("PASS")).alias("p"), F.count_if(_is("FAIL")).alias("f"), F.count_if(_is("SKIP")).alias("s")
    )
    wide = counts.groupBy(file_key).pivot(model, models).agg(
        F.sum("p").alias("pass"), F.sum("f").alias("fail"), F.sum("s").alias("skip")
    )
    numbers = [c for c in wide.columns if c != file_key]
    wide = wide.fillna(0, numbers)
    total = wide.agg(*[F.sum(c).alias(c) for c in numbers]).withColumn(
        file_key, F.lit(None).cast(rows.schema[file_key].dataType)
    )
    return wide.unionByName(total)


def regression_diff(run: DataFrame, base: DataFrame, file_key: str, keys: list[str]) -> DataFrame:
    """Per file the change of P/F/S, PASS rows lost and FAIL rows gained (by report and name)."""
    both = run.select(*keys, "name", "status", F.lit(1).alias("__r")).unionByName(
        base.select(*keys, "name", "status", F.lit(0).alias("__r"))
    )
    new, old = F.col("__r") == 1, F.col("__r") == 0
    by_name = both.groupBy(*keys, compact_key(F.col("name")).alias("__n")).agg(
        *[F.count_if(side & _is(st)).alias(f"__{tag}{st}")
          for side, tag in ((new, "n"), (old, "o")) for st in ("PASS", "FAIL", "SKIP")]
    )

    def delta(st: str) -> Column:
        return F.sum(F.col(f"__n{st}") - F.col(f"__o{st}"))

    return by_name.groupBy(file_key).agg(
        delta("PASS").alias("d_pass"), delta("FAIL").alias("d_fail"), delta("SKIP").alias("d_skip"),
        F.sum(F.greatest(F.col("__oPASS") - F.col("__nPASS"), F.lit(0))).alias("lost_pass"),
        F.sum(F.greatest(F.col("__nFAIL") - F.col("__oFAIL"), F.lit(0))).alias("new_fail"),
    )


def ground_truth_grade(rows: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Expected against given status.

    Rows are counted per key and status before the join, so a file with very many
    rows enters the join as three rows.
    """
    counts = rows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("__n"))
    return counts.join(truth, keys).groupBy("expected", "status").agg(F.sum("__n").alias("n_rows"))


def review_flags(rows: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """H8: rows whose trimmed name was repaired (`kind` recovered, average or column) need a look.

    Recovered values only near a limit, averages likewise and only PASS, a
    re-read limit column for every PASS. Duplicate names are all flagged.
    """
    marks = touched.groupBy(*keys, trim_ws(F.col("name")).alias("__t")).agg(
        *[F.bool_or(F.col("kind") == k).alias(f"__{k}") for k in ("recovered", "average", "column")]
    )
    d = rows.withColumn("__t", trim_ws(F.col("name"))).join(marks, [*keys, "__t"], "left")
    near = near_boundary(F.col("min"), F.col("max"), F.col("result"))
    flag = (
        (F.col("__recovered") & ~_is("SKIP") & near) | (F.col("__average") & _is("PASS") & near)
        | (F.col("__column") & _is("PASS"))
    )
    return d.withColumn("needs_review", F.col("needs_review") | F.coalesce(flag, F.lit(False))).drop(
        "__t", "__recovered", "__average", "__column"
    )


def promote_boundary(rows: DataFrame, grid_source: Column) -> DataFrame:
    """H7: with verified columns a result on a limit is a PASS to be looked at."""
    hit = (
        grid_source.isin(TRUSTED_GRIDS) & _is("SKIP") & (F.col("min") != F.col("max"))
        & ((F.col("result") == F.col("min")) | (F.col("result") == F.col("max")))
        & F.col("result").between(F.col("min"), F.col("max"))
    )
    hit = F.coalesce(hit, F.lit(False))
    return rows.withColumns({
        "status": F.when(hit, "PASS").otherwise(F.col("status")),
        "needs_review": F.col("needs_review") | hit,
        "reason_code": F.when(hit, "BOUNDARY_VERIFIED").otherwise(F.col("reason_code")),
    })


def column_trusted(engine: Column, grid_source: Column) -> Column:
    """H9: columns known from ruling lines, from vector geometry, or from a text layer without a grid; never inferred ones."""
    return F.coalesce(grid_source.isin(TRUSTED_GRIDS), (engine == "text-layer"), F.lit(False))


def margin_green(rows: DataFrame, engine: Column, grid_source: Column) -> DataFrame:
    """H9: clear the review flag of a PASS that is far from its limits in trusted columns."""
    trusted = column_trusted(engine, grid_source)
    v, lo, hi = F.col("result"), F.col("min"), F.col("max")

    def inside(x: Column) -> Column:
        return F.coalesce((x >= lo), F.lit(True)) & F.coalesce((x <= hi), F.lit(True))

    two_sided = lo.isNotNull() & hi.isNotNull()
    clearance = F.when(two_sided, F.least(F.abs(v - lo), F.abs(hi - v))).otherwise(F.coalesce(hi - v, v - lo))
    nearer = F.when(F.abs(v - lo) <= F.abs(hi - v), lo).otherwise(hi)
    binding = F.when(two_sided, nearer).otherwise(F.coalesce(hi, lo))
    whole = v == F.floor(v)
    shifts = F.forall(F.array(v / 10, v * 10, v / 100, v * 100), lambda a: inside(a) == inside(v))
    clear = (
        trusted & _is("PASS") & (v != 0) & binding.isNotNull() & (clearance / F.abs(v) >= GREEN_MARGIN)
        & (~whole | shifts) & ((binding == F.floor(binding)) | _key(F.col("result_raw")).contains("."))
    )
    return rows.withColumn("needs_review", F.col("needs_review") & ~F.coalesce(clear, F.lit(False)))
