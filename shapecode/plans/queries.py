"""Registered queries: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``.

Every query reads the driver tables (or data Spark derives from them) in
full; there are no id subsets or row caps except where a limit is the
feature itself (top-k, sampling).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecode.config import (ANOMALY_THRESHOLD, APNEA_LINE_FORMAT, APNEA_SAMPLES_PER_MINUTE, DC_OFFSET, EVENTS,
                              LINEITEM, SAMPLE_SEED, SPLIT_SEED, SWEEP_STEP, SWEEP_STEPS, SignalSpec)
from shapecode.functions import arrays as A
from shapecode.operators import chunked as CH
from shapecode.operators import coding, framing
from shapecode.operators import evaluate as EV
from shapecode.operators import kmeans as KM
from shapecode.operators import labels as LB
from shapecode.operators import seeding as SD
from shapecode.operators import vectorized as V
from shapecode.operators import words as WD
from shapecode.plans import detect as DT
from shapecode.plans import sqlgen as Q
from shapecode.session import ensure_checkpoint_dir
from shapecode.sinks import writers as WR
from shapecode.sources import binary as BIN
from shapecode.sources import events as EVT
from shapecode.sources import text as TXT
from shapecode.sources.tables import (ANNOTATION_CODES, embedding_windows, read_table, signal_annotations,
                                     signal_samples)

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def frames_of(spark: SparkSession, sf_dir: str, spec: SignalSpec) -> DataFrame:
    return framing.tumbling_frames(signal_samples(spark, sf_dir, spec), spec.frame_len)


_STORED: dict[tuple[str, str, str], str] = {}
SMALL_CHUNK = 2            # codes in a chunk of the query that merges chunks: the tables' dictionaries are far below CHUNK


def stored_codebook(spark: SparkSession, sf_dir: str, spec: SignalSpec) -> DataFrame:
    """The signal's trained dictionary, read from the store (K7, S13); trained and saved on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, spec.name)
    if key not in _STORED:
        path = scratch_dir(spark, f"codebook-{spec.name}")
        train, budget = KM.training_set(signal_samples(spark, sf_dir, spec), spec.w, spec.step)
        WR.save_codebook(KM.lloyd(train, budget, spec.w), path, spec.w, spec.step)
        _STORED[key] = path
    return WR.load_codebook(spark, _STORED[key], spec.w, spec.step).select("source_id", "code", "center")


def scored(spark: SparkSession, sf_dir: str, spec: SignalSpec, mode: str = "centered",
           method: str = "vectorized", samples: DataFrame | None = None) -> DataFrame:
    """Every frame of a source with a dictionary, coded against its trained dictionary.

    ``vectorized``: blocks of frames + Arrow/numpy nearest-code search;
    ``sql``: frame rows + higher-order functions.  Both give identical rows.
    """
    samples = samples if samples is not None else signal_samples(spark, sf_dir, spec)
    book = stored_codebook(spark, sf_dir, spec)
    if method == "vectorized":
        out = CH.score_samples(samples, book, spec.w, spec.n, mode)
    elif method == "chunked":
        out = CH.score_samples(samples, book, spec.w, spec.n, mode, chunk=SMALL_CHUNK)
    else:
        out = coding.score_frames(framing.tumbling_frames(samples, spec.frame_len), coding.pack_codebook(book), spec.w, spec.n, mode)
    return out.where(F.col("status") != "no_model")


# ---------------------------------------------------------------- samples, frames
@register("samples_scaled", (
    f"WITH samples AS ({Q.samples_cte(EVENTS)}) SELECT source_id, i, raw, value FROM samples"))
def samples_scaled(spark, sf_dir):
    """W1 index + P1 scale on the short signal."""
    return signal_samples(spark, sf_dir, EVENTS)


@register("frames_tumbling", (
    f"WITH samples AS ({Q.samples_cte(LINEITEM)}), frames AS ({Q.frames_cte(LINEITEM)}) "
    f"SELECT source_id, frame_no, frame_ref, CAST(len(frame) AS BIGINT) AS n_samples, frame[1] AS first_value, "
    f"frame[{LINEITEM.frame_len}] AS last_value, list_max(frame) AS max_value FROM frames"))
def frames_tumbling(spark, sf_dir):
    """W1 tumbling frames (A16 drops the partial tail)."""
    f = frames_of(spark, sf_dir, LINEITEM)
    return f.select("source_id", "frame_no", "frame_ref", F.size("frame").cast("bigint").alias("n_samples"),
                    F.col("frame")[0].alias("first_value"),
                    F.col("frame")[LINEITEM.frame_len - 1].alias("last_value"),
                    F.array_max("frame").alias("max_value"))


# ---------------------------------------------------------------- flagship
def _scores_sql(spec: SignalSpec, mode: str) -> str:
    return Q.trained_prefix(spec, mode) + ", scores AS (" + Q.scores_select(spec) + ") SELECT * FROM scores"


def _scores_out(df: DataFrame) -> DataFrame:
    return df.select("source_id", "frame_no", "frame_ref", coding.codes_string().alias("codes"), "status",
                     "score", (F.aggregate("coded", F.lit(0.0), lambda a, v: a + v) + F.lit(0.0)).alias("coded_sum"))


@register("frame_scores", _scores_sql(LINEITEM, "centered"))
def frame_scores(spark, sf_dir):
    """Flagship W10: frames -> dictionary codes -> reconstruction -> max |loss|."""
    return _scores_out(scored(spark, sf_dir, LINEITEM, "centered"))


@register("frame_scores_chunked", _scores_sql(LINEITEM, "centered"))
def frame_scores_chunked(spark, sf_dir):
    """W10 with dictionaries spread over several rows: partial arg-mins merged over the chunks."""
    return _scores_out(scored(spark, sf_dir, LINEITEM, "centered", method="chunked"))


@register("frame_scores_sql", _scores_sql(LINEITEM, "centered"))
def frame_scores_sql(spark, sf_dir):
    """W10 on the SQL coder (higher-order functions in the frame row)."""
    return _scores_out(scored(spark, sf_dir, LINEITEM, "centered", method="sql"))


@register("frame_scores_events", _scores_sql(EVENTS, "centered"))
def frame_scores_events(spark, sf_dir):
    """W10 on the short signal (W=8, 4 windows per frame)."""
    return _scores_out(scored(spark, sf_dir, EVENTS, "centered"))


@register("encode_tapered", _scores_sql(LINEITEM, "tapered"))
def encode_tapered(spark, sf_dir):
    """Batch coder variant (tapered, norm-scaled centres, no mean)."""
    return _scores_out(scored(spark, sf_dir, LINEITEM, "tapered"))


# ---------------------------------------------------------------- windows and features
LI = LINEITEM
_PRE_LI = f"WITH samples AS ({Q.samples_cte(LI)}), frames AS ({Q.frames_cte(LI)}), wins AS ({Q.windows_cte(LI)}), wstats AS ({Q.stats_cte(LI)})"


@register("frame_budget", (
    f"WITH samples AS ({Q.samples_cte(LI)}) SELECT source_id, CAST(count(*) AS BIGINT) AS n_samples, "
    f"CAST(count(*) // {LI.frame_len} AS BIGINT) AS n_frames, CAST(count(*) % {LI.frame_len} AS BIGINT) AS remainder "
    f"FROM samples GROUP BY 1"))
def frame_budget(spark, sf_dir):
    """Whole frames per source and the dropped remainder."""
    return framing.frame_budget(signal_samples(spark, sf_dir, LI), LI.frame_len)


@register("training_budget", f"WITH samples AS ({Q.samples_cte(LI)}) {Q.budget_cte(LI)}")
def training_budget(spark, sf_dir):
    """Sliding-window budget and dictionary size per source."""
    return framing.training_budget(signal_samples(spark, sf_dir, LI), LI.w, LI.step)


@register("windows_sliding", (
    f"WITH samples AS ({Q.samples_cte(LI)}), bud AS ({Q.budget_cte(LI)}), "
    f"sw AS (SELECT source_id, i, list(value) OVER (PARTITION BY source_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {LI.w - 1} FOLLOWING) AS w FROM samples) "
    f"SELECT sw.source_id, CAST(i // {LI.step} AS BIGINT) AS j, i AS start, w[1] AS first_value, w[{LI.w}] AS last_value, "
    f"{Q.lsum('w')} AS w_sum FROM sw JOIN bud USING (source_id) "
    f"WHERE i % {LI.step} = 0 AND i // {LI.step} < bud.tr AND len(w) = {LI.w}"))
def windows_sliding(spark, sf_dir):
    """W2 + A15: the training windows (step W/10, first 20 %) of every source."""
    s = signal_samples(spark, sf_dir, LI)
    wins = framing.sliding_windows(s, LI.w, LI.step, framing.training_budget(s, LI.w, LI.step))
    return wins.select("source_id", "j", "start", F.col("w")[0].alias("first_value"),
                       F.col("w")[LI.w - 1].alias("last_value"),
                       F.aggregate("w", F.lit(0.0), lambda a, v: a + v).alias("w_sum"))


@register("windows_half_overlap", (
    _PRE_LI + f" SELECT source_id, frame_no, k, CAST(k * {LI.h} AS INTEGER) AS start, x[1] AS first_value, x[{LI.w}] AS last_value FROM wins"))
def windows_half_overlap(spark, sf_dir):
    """2n-1 half-overlapping windows per frame."""
    w = framing.half_overlap_windows(frames_of(spark, sf_dir, LI), LI.w, LI.n)
    return w.select("source_id", "frame_no", F.col("k").cast("int").alias("k"), F.col("start").cast("int").alias("start"),
                    F.col("w")[0].alias("first_value"), F.col("w")[LI.w - 1].alias("last_value"))


@register("window_stats", _PRE_LI + " SELECT source_id, frame_no, k, avg, nrm FROM wstats")
def window_stats(spark, sf_dir):
    """A3/A4: mean and L2 norm of every half-overlap window."""
    f = coding.with_features(frames_of(spark, sf_dir, LI), LI.w, LI.n, "centered")
    return coding.window_rows(f).select("source_id", "frame_no", F.col("k").cast("int").alias("k"), "avg", "nrm")


def _feature_stats(df):
    return df.select("source_id", "frame_no", F.col("k").cast("int").alias("k"),
                     F.aggregate("feat", F.lit(0.0), lambda a, v: a + v).alias("feat_sum"),
                     F.aggregate("feat", F.lit(0.0), lambda a, v: a + v * v).alias("feat_sumsq"))


_FEAT_SQL = (" SELECT source_id, frame_no, k, {s} AS feat_sum, {q} AS feat_sumsq FROM feats"
             .format(s=Q.lsum("feat"), q=Q.lsum("list_transform(feat, lambda v: v * v)")))


@register("features_centered", _PRE_LI + f", feats AS ({Q.centered_feats_cte(LI)})" + _FEAT_SQL)
def features_centered(spark, sf_dir):
    """P7 + W4 + W5: centred, norm-scaled, tapered window features."""
    f = coding.with_features(frames_of(spark, sf_dir, LI), LI.w, LI.n, "centered")
    return _feature_stats(coding.window_rows(f))


@register("features_tapered", _PRE_LI + f", feats AS ({Q.tapered_feats_cte(LI)})" + _FEAT_SQL)
def features_tapered(spark, sf_dir):
    """Tapered window divided by its tapered norm."""
    f = coding.with_features(frames_of(spark, sf_dir, LI), LI.w, LI.n, "tapered")
    return _feature_stats(coding.window_rows(f))


def _taper_ola_sql(spec: SignalSpec) -> str:
    h, w = spec.h, spec.w
    t = Q.dlist(A.taper_values(w))
    seg = f"list_transform(range({h}), lambda p: pr.x[{h} + p + 1] * ({t})[{h} + p + 1] + c.x[p + 1] * ({t})[p + 1])"
    m = spec.frame_len - w
    return (
        f"WITH samples AS ({Q.samples_cte(spec)}), frames AS ({Q.frames_cte(spec)}), wins AS ({Q.windows_cte(spec)}), "
        f"seg AS (SELECT c.source_id, c.frame_no, c.k AS j, {seg} AS s FROM wins c JOIN wins pr "
        f"ON pr.source_id = c.source_id AND pr.frame_no = c.frame_no AND pr.k = c.k - 1), "
        f"ola AS (SELECT source_id, frame_no, flatten(list(s ORDER BY j)) AS o FROM seg GROUP BY 1, 2) "
        f"SELECT f.source_id, f.frame_no, list_max(list_transform(range({m}), lambda p: abs(o[p + 1] - f.frame[{h} + p + 1]))) AS ola_max_err "
        f"FROM frames f JOIN ola USING (source_id, frame_no)"
    )


@register("taper_overlap_check", _taper_ola_sql(LI))
def taper_overlap_check(spark, sf_dir):
    """Overlap-add of tapered raw windows vs the trimmed frame (the taper
    halves sum to 0.9868..0.9999, not exactly 1, for W=120)."""
    f = coding.with_windows(frames_of(spark, sf_dir, LI), LI.w, LI.n)
    taper = A.array_literal(A.taper_values(LI.w))
    f = f.withColumn("tw", F.expr(A.tapered_windows_expr("wins", taper)))
    h = LI.h
    ola = F.expr(f"flatten(transform(sequence(1, size(tw) - 1), j -> zip_with(slice(tw[j - 1], {h + 1}, {h}), "
                 f"slice(tw[j], 1, {h}), (p, q) -> p + q)))")
    f = f.withColumn("ola", ola).withColumn("src", framing.trimmed("frame", LI.w, LI.n))
    return f.select("source_id", "frame_no",
                    F.expr("array_max(zip_with(ola, src, (a, b) -> abs(a - b)))").alias("ola_max_err"))


@register("taper_sums", f"WITH samples AS ({Q.samples_cte(LI)}), frames AS ({Q.frames_cte(LI)}), "
          f"t AS (SELECT {Q.dlist(A.taper_values(LI.w))} AS t) "
          f"SELECT source_id, frame_ref, CAST(len(frame) - {LI.w} AS BIGINT) AS n_sums, list_min(s) AS least, list_max(s) AS most, {Q.lsum('s')} AS total FROM ("
          f"SELECT f.*, list_transform(range({LI.frame_len - LI.w}), lambda i: t[{LI.h} + i % {LI.h} + 1] + t[i % {LI.h} + 1]) AS s FROM frames f, t)")
def taper_sums(spark, sf_dir):
    """``w(i) + w(i + H)`` at every sample that two windows of a frame cover."""
    f = frames_of(spark, sf_dir, LI).withColumn("t", F.expr(A.array_literal(A.taper_values(LI.w))))
    f = f.withColumn("s", F.transform(F.sequence(F.lit(0), F.size("frame") - F.lit(LI.w + 1)),
                                      lambda i: F.get("t", i % LI.h + LI.h) + F.get("t", i % LI.h)))
    return f.select("source_id", "frame_ref", F.size("s").cast("bigint").alias("n_sums"), F.array_min("s").alias("least"), F.array_max("s").alias("most"),
                    F.aggregate("s", F.lit(0.0), lambda a, v: a + v).alias("total"))


# ---------------------------------------------------------------- coding details
@register("nearest_code", Q.trained_prefix(LI, "centered") + " SELECT source_id, frame_no, CAST(k AS INTEGER) AS k, code, d FROM nearest")
def nearest_code(spark, sf_dir):
    """Nearest dictionary code (least squared distance, ties -> lowest code)."""
    df = scored(spark, sf_dir, LI, "centered")
    return (df.select("source_id", "frame_no", F.posexplode("best").alias("k", "b"))
            .where(F.col("b").isNotNull())
            .select("source_id", "frame_no", F.col("k").cast("int").alias("k"),
                    F.col("b.code").alias("code"), F.col("b.d").alias("d")))


_CODED_LI = Q.trained_prefix(LI, "centered") + f", ca AS ({Q.coded_arrays_select(LI)})"


@register("frame_profile", _CODED_LI + (
    " SELECT source_id, frame_ref, list_max(src) AS max_src, list_max(coded) AS max_coded, "
    "list_max(loss) AS max_loss, list_min(loss) AS min_loss, score AS max_abs_loss FROM ca"))
def frame_profile(spark, sf_dir):
    """Per-frame maxima (source, coded, loss)."""
    from shapecode.operators.evaluate import frame_profile as fp
    return fp(scored(spark, sf_dir, LI, "centered"))


@register("loss_histogram", _CODED_LI + (
    ", hb AS (SELECT source_id, frame_ref, loss, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo2, "
    "CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi2 FROM (SELECT *, list_min(loss) AS lo, list_max(loss) AS hi FROM ca)), "
    "hw AS (SELECT *, (hi2 - lo2) / 50 AS wd, len(loss) AS n FROM hb), "
    "he AS (SELECT source_id, frame_ref, least(CAST(floor((unnest(loss) - lo2) / wd) AS INTEGER), 49) AS bin FROM hw), "
    "hc AS (SELECT source_id, frame_ref, bin, count(*) AS c FROM he GROUP BY ALL), "
    "hg AS (SELECT source_id, frame_ref, lo2, wd, n, CAST(unnest(range(0, 50)) AS INTEGER) AS bin FROM hw WHERE n > 0) "
    "SELECT source_id, frame_ref, bin, lo2 + bin * wd AS bin_lo, CAST(coalesce(c, 0) AS BIGINT) AS cnt, "
    "coalesce(c, 0) / (n * wd) AS height FROM hg LEFT JOIN hc USING (source_id, frame_ref, bin)"))
def loss_histogram(spark, sf_dir):
    """50-bin density histogram of each frame's loss."""
    from shapecode.operators.evaluate import loss_histogram as lh
    return lh(scored(spark, sf_dir, LI, "centered"))


@register("frame_slice", (
    f"WITH samples AS ({Q.samples_cte(LI)}), frames AS ({Q.frames_cte(LI)}) "
    f"SELECT source_id, frame_ref, CAST(len(part) AS BIGINT) AS slice_len, part[1] AS slice_first, part[40] AS slice_last, "
    f"list_max(part) AS slice_max, {Q.lsum('part')} AS slice_sum FROM (SELECT *, frame[11 : 50] AS part FROM frames)"))
def frame_slice(spark, sf_dir):
    """Inspection slice ``[10:50]`` of every frame."""
    f = frames_of(spark, sf_dir, LI).withColumn("part", F.slice("frame", 11, 40))
    return f.select("source_id", "frame_ref", F.size("part").cast("bigint").alias("slice_len"),
                    F.col("part")[0].alias("slice_first"), F.col("part")[39].alias("slice_last"),
                    F.array_max("part").alias("slice_max"),
                    F.aggregate("part", F.lit(0.0), lambda a, v: a + v).alias("slice_sum"))


@register("frame_centred_view", _CODED_LI + (
    f" SELECT source_id, frame_ref, list_min(list_transform(src, lambda v: v - {Q.dlit(DC_OFFSET)})) AS min_centred, "
    f"list_max(list_transform(src, lambda v: v - {Q.dlit(DC_OFFSET)})) AS max_centred, "
    f"list_min(list_transform(coded, lambda v: v - {Q.dlit(DC_OFFSET)})) AS min_centred_coded, "
    f"list_max(list_transform(coded, lambda v: v - {Q.dlit(DC_OFFSET)})) AS max_centred_coded FROM ca"))
def frame_centred_view(spark, sf_dir):
    """Source and reconstruction minus the DC offset 1024/200 for display."""
    df = scored(spark, sf_dir, LI, "centered")
    c, d = (F.transform(x, lambda v: v - F.lit(DC_OFFSET)) for x in ("src", "coded"))
    return df.select("source_id", "frame_ref", F.array_min(c).alias("min_centred"), F.array_max(c).alias("max_centred"),
                     F.array_min(d).alias("min_centred_coded"), F.array_max(d).alias("max_centred_coded"))


# ---------------------------------------------------------------- labels and evaluation

_LAB_LI = "WITH " + Q.labels_ctes(LI, ANNOTATION_CODES["lineitem"])


def labels_of(spark, sf_dir, spec=LI):
    return LB.frame_labels(signal_annotations(spark, sf_dir, spec), spec.frame_len)


@register("frame_labels", _LAB_LI + " SELECT record_id, frame_ref, label FROM labels")
def frame_labels(spark, sf_dir):
    """A11/A17: 'N' + the non-N codes of each frame, frames up to the last annotation."""
    return labels_of(spark, sf_dir, LI)


@register("frame_labels_events", "WITH " + Q.labels_ctes(EVENTS, ANNOTATION_CODES["events"])
          + " SELECT record_id, frame_ref, label FROM labels")
def frame_labels_events(spark, sf_dir):
    """A11 on the short signal: codes from event kinds (click/view normal)."""
    return labels_of(spark, sf_dir, EVENTS)


def _quarantine_sql(spec: SignalSpec) -> str:
    return ("WITH " + Q.labels_ctes(spec, ANNOTATION_CODES[spec.name]) + (
        f", nf AS (SELECT record_id, CAST(ceil(last_sample / {spec.frame_len}) AS BIGINT) AS n_frames FROM ext) "
        f"SELECT a.record_id, a.line_no, a.sample, a.code, nf.n_frames FROM ann a JOIN nf USING (record_id) "
        f"WHERE a.code <> 'N' AND a.sample // {spec.frame_len} >= nf.n_frames"))


@register("annotation_quarantine", _quarantine_sql(LI))
def annotation_quarantine(spark, sf_dir):
    """Codes past the last labelled frame (the reference fails on them)."""
    return LB.out_of_range_codes(signal_annotations(spark, sf_dir, LI), LI.frame_len)


@register("annotation_quarantine_events", _quarantine_sql(EVENTS))
def annotation_quarantine_events(spark, sf_dir):
    """Out-of-range codes on the short signal (a code on the last sample that
    falls exactly on a frame boundary)."""
    return LB.out_of_range_codes(signal_annotations(spark, sf_dir, EVENTS), EVENTS.frame_len)


def cutoffs_of(samples, spec=LI):
    b = framing.training_budget(samples, spec.w, spec.step)
    return b.select("source_id", F.col("samples_used").alias("cutoff"))


def labelled_of(spark, sf_dir, spec=LI):
    """Scores, labels and training cut-offs from one indexed sample table."""
    samples = signal_samples(spark, sf_dir, spec, extra={"code": ANNOTATION_CODES[spec.name]})
    ann = samples.where(F.col("code").isNotNull()).select(
        F.col("source_id").alias("record_id"), F.col("i").alias("line_no"), F.col("i").alias("sample"), "code")
    labels = LB.frame_labels(ann, spec.frame_len)
    lf = EV.labelled_frames(scored(spark, sf_dir, spec, "centered", samples=samples), labels)
    return EV.with_region(lf, cutoffs_of(samples, spec))


_EVAL_PRE = (Q.trained_prefix(LI, "centered") + f", scores AS ({Q.scores_select(LI)}), "
             + Q.labels_ctes(LI, ANNOTATION_CODES["lineitem"])
             + ", lf AS (SELECT s.source_id, s.frame_ref, l.label, s.score, CASE WHEN s.frame_ref <= bud.samples_used "
             "THEN 'train' ELSE 'rest' END AS region FROM scores s JOIN labels l ON s.source_id = l.record_id "
             "AND s.frame_ref = l.frame_ref LEFT JOIN bud ON s.source_id = bud.source_id), "
             "rest AS (SELECT * FROM lf WHERE region = 'rest'), "
             f"sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_id ORDER BY "
             f"md5(concat_ws(':', '{SPLIT_SEED}', CAST(source_id AS VARCHAR), CAST(frame_ref AS VARCHAR)))) - 1 < "
             f"floor({Q.dlit(0.4)} * count(*) OVER (PARTITION BY source_id)) THEN 'validation' ELSE 'test' END AS split FROM rest), "
             "val AS (SELECT * FROM sp WHERE split = 'validation'), tst AS (SELECT * FROM sp WHERE split = 'test'), "
             f"grid AS (SELECT CAST(r.i AS BIGINT) AS t_index, r.i * {Q.dlit(SWEEP_STEP)} AS t FROM range(0, {SWEEP_STEPS}) r(i)), "
             "curve AS (SELECT t_index, t, unscored, n, pos, neg, fn, fp, 100 * (fn + fp) / n AS total_pct, 100 * fp / n AS fp_pct, "
             "100 * fn / n AS fn_pct FROM (SELECT g.t_index, g.t, "
             "(SELECT CAST(count_if(score IS NULL) AS BIGINT) FROM val) AS unscored, "
             "(SELECT CAST(count(score) AS BIGINT) FROM val) AS n, "
             "(SELECT CAST(count_if(label <> 'N' AND score IS NOT NULL) AS BIGINT) FROM val) AS pos, "
             "(SELECT CAST(count_if(label = 'N' AND score IS NOT NULL) AS BIGINT) FROM val) AS neg, "
             "(SELECT CAST(count_if(v.label <> 'N' AND v.score < g.t) AS BIGINT) FROM val v) AS fn, "
             "(SELECT CAST(count_if(v.label = 'N' AND v.score >= g.t) AS BIGINT) FROM val v) AS fp FROM grid g)), "
             "best AS (SELECT * FROM curve ORDER BY total_pct, t_index LIMIT 1)")


def _errors_sql(rel: str, t: str) -> str:
    return (f" SELECT CAST(count_if(score IS NULL) AS BIGINT) AS unscored, CAST(count(score) AS BIGINT) AS n, "
            f"CAST(count_if(label <> 'N' AND score IS NOT NULL) AS BIGINT) AS pos, "
            f"CAST(count_if(label = 'N' AND score IS NOT NULL) AS BIGINT) AS neg, max({t}) AS t, "
            f"100 * (count_if(label <> 'N' AND score < {t}) + count_if(label = 'N' AND score >= {t})) / count(score) AS total_pct, "
            f"100 * count_if(label = 'N' AND score >= {t}) / count(score) AS fp_pct, "
            f"100 * count_if(label <> 'N' AND score < {t}) / count(score) AS fn_pct FROM {rel}")


@register("labelled_frames", _EVAL_PRE + " SELECT source_id, frame_ref, label, score, region FROM lf")
def labelled_frames(spark, sf_dir):
    """J1 + P4: scored frames joined with labels, tagged train / rest."""
    return labelled_of(spark, sf_dir).select("source_id", "frame_ref", "label", "score", "region")


def split_of(spark, sf_dir):
    rest = labelled_of(spark, sf_dir).where(F.col("region") == "rest").select("source_id", "frame_ref", "label", "score")
    return EV.split_validation_test(rest)


@register("split_val_test", _EVAL_PRE + " SELECT source_id, frame_ref, label, score, split FROM sp")
def split_val_test(spark, sf_dir):
    """L4: reproducible 40/60 validation/test split of the held-out frames, per source."""
    return split_of(spark, sf_dir)


@register("frame_sample", _EVAL_PRE + (
    f" SELECT source_id, frame_ref, label, score FROM lf ORDER BY "
    f"md5(concat_ws(':', '{SAMPLE_SEED}', CAST(source_id AS VARCHAR), CAST(frame_ref AS VARCHAR))) LIMIT 20"))
def frame_sample(spark, sf_dir):
    """L3: reproducible sample of 20 labelled frames."""
    return EV.sample_frames(labelled_of(spark, sf_dir).select("source_id", "frame_ref", "label", "score"), 20)


@register("errors_at_threshold", _EVAL_PRE + _errors_sql("val", Q.dlit(ANOMALY_THRESHOLD)))
def errors_at_threshold(spark, sf_dir):
    """Validation errors at the fixed online threshold."""
    val = split_of(spark, sf_dir).where(F.col("split") == "validation")
    return EV.errors_at(val, ANOMALY_THRESHOLD)


@register("threshold_sweep", _EVAL_PRE + " SELECT * FROM curve")
def threshold_sweep(spark, sf_dir):
    """The 500-threshold error curve on the validation frames."""
    return EV.threshold_sweep(split_of(spark, sf_dir).where(F.col("split") == "validation"))


@register("best_threshold", _EVAL_PRE + " SELECT * FROM best")
def best_threshold(spark, sf_dir):
    """A10: threshold with the least validation error (lowest on ties)."""
    return EV.best_threshold(EV.threshold_sweep(split_of(spark, sf_dir).where(F.col("split") == "validation")))


@register("test_error", _EVAL_PRE + _errors_sql("tst", "(SELECT t FROM best)"))
def test_error(spark, sf_dir):
    """A8 on the test frames at the chosen threshold."""
    sp = split_of(spark, sf_dir)
    best = EV.best_threshold(EV.threshold_sweep(sp.where(F.col("split") == "validation")))
    # the chosen threshold enters as a scalar subquery (one row, one column)
    return EV.errors_at(sp.where(F.col("split") == "test"), best.select("t").scalar())


# ---------------------------------------------------------------- anomalies
EV_ = EVENTS
_ANOM_PRE = Q.trained_prefix(EV_, "centered") + f", scores AS ({Q.scores_select(EV_)})"


@register("anomalies", _ANOM_PRE + f" SELECT source_id, frame_ref, score FROM scores WHERE score > {Q.dlit(ANOMALY_THRESHOLD)}")
def anomalies(spark, sf_dir):
    """Frames whose score is strictly above the online threshold."""
    df = scored(spark, sf_dir, EV_, "centered")
    return df.where(F.col("score") > F.lit(ANOMALY_THRESHOLD)).select("source_id", "frame_ref", "score")


# ---------------------------------------------------------------- words

_WORDS = ("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents), "
          "totals AS (SELECT lower(word) AS word, CAST(count(*) AS BIGINT) AS word_count FROM w GROUP BY 1)")


def totals_of(spark, sf_dir):
    return WD.word_totals(WD.word_rows(read_table(spark, sf_dir, "documents")))


@register("word_totals", _WORDS + " SELECT word, word_count FROM totals")
def word_totals(spark, sf_dir):
    """A1 + P9: total count per lower-cased word."""
    return totals_of(spark, sf_dir)


@register("word_topk", _WORDS + " SELECT word, word_count FROM totals ORDER BY word_count DESC, word LIMIT 10")
def word_topk(spark, sf_dir):
    """L2: ten most frequent words."""
    return WD.top_words(totals_of(spark, sf_dir), 10)


@register("word_filter", _WORDS + " SELECT word, word_count FROM totals WHERE word_count > 100")
def word_filter(spark, sf_dir):
    """P10: words seen more than 100 times."""
    return WD.words_over(totals_of(spark, sf_dir), 100)


# ---------------------------------------------------------------- dictionary training

@register("codebook_lloyd", "WITH " + Q.lloyd_ctes(LI, KM.ITERATIONS) + (
    f" SELECT source_id, code, {Q.r6(Q.lsum('center'))} AS center_sum, "
    f"{Q.r6(Q.lsum('list_transform(center, lambda v: v * v)'))} AS center_sumsq FROM c{KM.ITERATIONS}"))
def codebook_lloyd(spark, sf_dir):
    """A13(b)-A15: all-source Lloyd k-means, 20 iterations, saved to and read from the store."""
    cb = stored_codebook(spark, sf_dir, LI)
    return cb.select("source_id", "code",
                     F.round(F.aggregate("center", F.lit(0.0), lambda a, v: a + v), 6).alias("center_sum"),
                     F.round(F.aggregate("center", F.lit(0.0), lambda a, v: a + v * v), 6).alias("center_sumsq"))


@register("codebook_seeds", "WITH " + ", ".join(Q.lloyd_train_ctes(LI)) + ", " + Q.seeds_ctes(LI.w, SD.ROUNDS, SD.SEED) + (
    f" SELECT s.source_id, s.code, CAST(s.j AS BIGINT) AS j, CASE WHEN t.feat IS NULL THEN CAST(0 AS DOUBLE) ELSE {Q.lsum('t.feat')} END AS center_sum "
    "FROM seeds s JOIN train t ON t.source_id = s.source_id AND t.j = s.j"))
def codebook_seeds(spark, sf_dir):
    """A13 seeding: k-means|| for all sources at once, drawn by hashes."""
    train, budget = KM.training_set(signal_samples(spark, sf_dir, LI), LI.w, LI.step)
    s = SD.parallel_seeds(train, budget, LI.w)
    return s.select("source_id", "code", "j", F.aggregate("center", F.lit(0.0), lambda a, v: a + v).alias("center_sum"))


# ---------------------------------------------------------------- wire format, archive, detector


_T_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def raw_event_frames(spark, sf_dir, spec=EVENTS):
    """Frames of raw samples plus the epoch seconds of their first sample."""
    s = signal_samples(spark, sf_dir, spec, extra={"t_us": _T_US})
    f = framing.tumbling_frames(s, spec.frame_len, value_col="raw", extra_aggs={"t0": F.min("t_us")})
    return f.withColumn("src_ts", F.col("t0") / F.lit(1000000))


def scratch_dir(spark, name):
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


_EV_FRAMES_SQL = (
    f"WITH s AS (SELECT CAST(user_id AS BIGINT) AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, "
    f"CAST(value AS DOUBLE) AS raw, epoch_us(ts) AS t_us FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL), "
    f"f AS (SELECT source_id, i // {EVENTS.frame_len} AS frame_no, min(t_us) AS t0, list(raw ORDER BY i) AS data FROM s "
    f"GROUP BY 1, 2 HAVING count(*) = {EVENTS.frame_len})")


@register("frame_event_roundtrip", _EV_FRAMES_SQL + (
    f" SELECT CAST(source_id AS VARCHAR) AS patient_id, CAST(frame_no * {EVENTS.frame_len} AS BIGINT) AS frame_ref, "
    f"t0 / 1000000 AS src_ts, CAST(len(data) AS BIGINT) AS n_samples, "
    f"{Q.lsum(f'list_transform(data, lambda v: v * {Q.dlit(EVENTS.scale)})')} AS data_sum, 'ok' AS status FROM f"))
def frame_event_roundtrip(spark, sf_dir):
    """K9 -> S2 -> P2 -> P1: frames published as JSON events and decoded back."""
    ev = EVT.frame_events(raw_event_frames(spark, sf_dir))
    d = EVT.decode_frame_events(ev)
    return d.select("patient_id", "frame_ref", F.col("srcTs").alias("src_ts"),
                    F.size("frame").cast("bigint").alias("n_samples"),
                    F.aggregate("frame", F.lit(0.0), lambda a, v: a + v).alias("data_sum"), "status")


def _event_books(spark, sf_dir, spec=EVENTS):
    return coding.pack_codebook(stored_codebook(spark, sf_dir, spec).withColumn("source_id", F.col("source_id").cast("string")))


_STREAM_SQL = (Q.trained_prefix(EVENTS, "centered") + f", scores AS ({Q.scores_select(EVENTS)}) "
               "SELECT CAST(source_id AS VARCHAR) AS patient_id, frame_ref, score, codes, status FROM scores")


@register("stream_detect", _STREAM_SQL)
def stream_detect(spark, sf_dir):
    """Frame events replayed as files through the Structured
    Streaming detector (availableNow); returns the archived scores."""
    root = scratch_dir(spark, "stream")
    EVT.frame_events(raw_event_frames(spark, sf_dir)).write.mode("overwrite").text(f"{root}/in")
    from shapecode.streaming.detector import file_frames, start_detector
    stored_codebook(spark, sf_dir, EVENTS)      # the detector reads the store for every micro-batch
    q = start_detector(file_frames(spark, f"{root}/in"), lambda: _event_books(spark, sf_dir),
                       f"{root}/archive", f"{root}/anomalies", f"{root}/quarantine", f"{root}/_chk",
                       available_now=True, w=EVENTS.w, n=EVENTS.n)
    q.awaitTermination()
    arch = spark.read.parquet(f"{root}/archive")
    return arch.select("patient_id", "frame_ref", "score", "codes", "status")


@register("anomaly_json", Q.trained_prefix(EVENTS, "centered") + f", scores AS ({Q.scores_select(EVENTS)}), ca AS ({Q.coded_arrays_select(EVENTS)}), " + (
    Q.event_times_ctes(EVENTS) +
    "SELECT 'inj./data/' || CAST(s.source_id AS VARCHAR) || '.dat' AS srcId, t0 / 1000000 AS srcTs, CAST(s.frame_ref AS DOUBLE) AS frameRef, "
    f"s.score AS maxLoss, {Q.utc_path('t0')} AS timePathRef, {Q.data_slice('ca.src', 'ca.coded', 'ca.loss')} AS dataSlice "
    "FROM scores s JOIN t0 ON t0.source_id = s.source_id AND t0.frame_no = s.frame_no "
    f"JOIN ca ON ca.source_id = s.source_id AND ca.frame_ref = s.frame_ref WHERE s.score > {Q.dlit(ANOMALY_THRESHOLD)}"))
def anomaly_json(spark, sf_dir):
    """P5/K2: anomaly records as JSON (``dataSlice`` = first 60 characters),
    parsed back to check the wire format, all six fields."""
    ev = EVT.frame_events(raw_event_frames(spark, sf_dir))
    scored_ = DT.with_time_path(DT.detect(ev, _event_books(spark, sf_dir), EVENTS.w, EVENTS.n))
    js = WR.anomaly_json(DT.anomalies(scored_))
    back = js.select(F.from_json("value", "srcId STRING, srcTs DOUBLE, frameRef DOUBLE, maxLoss DOUBLE, "
                                          "timePathRef STRING, dataSlice STRING").alias("r"))
    return back.select("r.*")


@register("no_model_frames", "WITH " + Q.lloyd_ctes(EVENTS, 0) + (
    f", frames AS ({Q.frames_cte(EVENTS)}) SELECT source_id, frame_ref, 'no_model' AS status FROM frames "
    f"WHERE source_id NOT IN (SELECT source_id FROM c0)"))
def no_model_frames(spark, sf_dir):
    """J2 misses: frames of sources without a trained dictionary (too short
    to train one); kept with status ``no_model`` instead of failing."""
    cb = stored_codebook(spark, sf_dir, EVENTS)
    sc = coding.score_frames(frames_of(spark, sf_dir, EVENTS), coding.pack_codebook(cb), EVENTS.w, EVENTS.n)
    return sc.where(F.col("status") == "no_model").select("source_id", "frame_ref", "status")


@register("archive_roundtrip", Q.trained_prefix(LI, "centered") + f", ca AS ({Q.coded_arrays_select(LI)}) " + (
    "SELECT 'inj./data/' || CAST(source_id AS VARCHAR) || '.dat' AS srcId, frame_ref, score AS max_err, "
    "CAST(len(src) AS BIGINT) AS n_src, CAST(len(coded) AS BIGINT) AS n_coded, CAST(len(loss) AS BIGINT) AS n_loss, "
    f"{Q.lsum('loss')} AS loss_sum FROM ca"))
def archive_roundtrip(spark, sf_dir):
    """K1 text archive written and read back with the S6 parser (and the
    K5/S7 ``src;coded;loss`` form checked in tests)."""
    sc = scored(spark, sf_dir, LI, "centered")
    sc = sc.withColumn("srcId", F.concat(F.lit("inj./data/"), F.col("source_id").cast("string"), F.lit(".dat"))) \
           .withColumn("srcTs", F.lit(0.0)).withColumn("time_path", F.lit("batch/"))
    path = scratch_dir(spark, "archive")
    WR.archive_lines(sc).write.text(path)
    back = TXT.parse_archive(spark.read.text(path))
    return back.select("srcId", "frame_ref", "max_err", F.size("src").cast("bigint").alias("n_src"),
                       F.size("coded").cast("bigint").alias("n_coded"), F.size("loss").cast("bigint").alias("n_loss"),
                       F.aggregate("loss", F.lit(0.0), lambda a, v: a + v).alias("loss_sum"))


_S212 = {"s1": "CAST(l_quantity AS INT)", "s2": "CAST(l_partkey % 4096 AS INT)"}
_DEC_SQL = (f"WITH samples AS (SELECT CAST(l_suppkey AS BIGINT) AS source_id, CAST(row_number() OVER (PARTITION BY l_suppkey "
            f"ORDER BY {', '.join(LI.order_cols)}) - 1 AS BIGINT) AS i, {_S212['s1']} AS s1, {_S212['s2']} AS s2 "
            f"FROM lineitem WHERE l_suppkey IS NOT NULL AND l_quantity IS NOT NULL)")


def _expected_212(spark, sf_dir):
    return signal_samples(spark, sf_dir, LI, extra=_S212).select("source_id", "i", "s1", "s2")


def _decoded_212(spark, sf_dir):
    files = BIN.pack_212(_expected_212(spark, sf_dir))
    return BIN.decode_212(files).select("source_id", "i", "s1", "s2")


@register("decode_212", _DEC_SQL + " SELECT source_id, i, s1, s2 FROM samples")
def decode_212(spark, sf_dir):
    """S3: format-212 records (packed from table data in bounded blocks) decoded."""
    return _decoded_212(spark, sf_dir)


@register("decode_check", _DEC_SQL + (
    " SELECT source_id, CAST(count(*) AS BIGINT) AS n_checked, CAST(0 AS BIGINT) AS n_mismatch FROM samples GROUP BY 1"))
def decode_check(spark, sf_dir):
    """Decoded vs expected samples by position (null-safe), per source."""
    dec, exp = _decoded_212(spark, sf_dir).alias("d"), _expected_212(spark, sf_dir).alias("e")
    j = exp.join(dec, ["source_id", "i"], "full_outer")
    bad = ~(F.col("d.s1").eqNullSafe(F.col("e.s1")) & F.col("d.s2").eqNullSafe(F.col("e.s2")))
    return j.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_checked"),
                                      F.count_if(bad).cast("bigint").alias("n_mismatch"))


_APNEA_CODE = "CASE WHEN event_type = 'error' THEN 'A' ELSE 'N' END"


@register("apnea_labels", (
    f"WITH a AS (SELECT CAST(user_id AS BIGINT) AS record_id, CAST(row_number() OVER (PARTITION BY user_id "
    f"ORDER BY ts, event_id) - 1 AS BIGINT) AS n, {_APNEA_CODE} AS code FROM events "
    f"WHERE user_id IS NOT NULL AND value IS NOT NULL) "
    f"SELECT record_id, n, n * {APNEA_SAMPLES_PER_MINUTE} AS sample, CAST(n // 60 AS INTEGER) AS hh, "
    f"CAST(n % 60 AS INTEGER) AS mm, code, printf('{APNEA_LINE_FORMAT}', n, n * {APNEA_SAMPLES_PER_MINUTE}, "
    f"n // 60, n % 60, code) AS line FROM a"))
def apnea_labels(spark, sf_dir):
    """Per-minute apnea records (8 bytes, byte 1 = 0x20 means A),
    packed from the events table in bounded blocks and decoded back."""
    s = signal_samples(spark, sf_dir, EVENTS, extra={"_b1": "CASE WHEN event_type = 'error' THEN '20' ELSE '10' END"})
    rec = F.concat(F.lit("00"), F.col("_b1"), F.lit("000000000000"))
    files = BIN.pack_records(s.withColumn("_hex", rec), "_hex")
    d = BIN.decode_apnea(files)
    return d.select("record_id", "n", "sample", "hh", "mm", "code", "line")


@register("encode_centered", _CODED_LI + (
    f" SELECT source_id, frame_ref, CAST(len(coded) AS BIGINT) AS n_coded, coded[1] AS coded_first, "
    f"coded[{LI.frame_len - LI.w}] AS coded_last, {Q.lsum('coded')} AS coded_sum, {Q.lsum('loss')} AS loss_sum FROM ca"))
def encode_centered(spark, sf_dir):
    """W7 + W9: the reconstruction (online variant) and residual of every frame."""
    df = scored(spark, sf_dir, LI, "centered")
    m = LI.frame_len - LI.w
    return df.select("source_id", "frame_ref", F.size("coded").cast("bigint").alias("n_coded"),
                     F.col("coded")[0].alias("coded_first"), F.col("coded")[m - 1].alias("coded_last"),
                     F.aggregate("coded", F.lit(0.0), lambda a, v: a + v).alias("coded_sum"),
                     F.aggregate("loss", F.lit(0.0), lambda a, v: a + v).alias("loss_sum"))


@register("codebook_store_roundtrip", "WITH " + Q.lloyd_ctes(EVENTS, KM.ITERATIONS) + (
    f", coarse AS (SELECT source_id, code, 16 AS w, 2 AS step, CAST(16 AS BIGINT) AS n, {Q.r6(Q.lsum('list_concat(center, center)'))} AS center_sum "
    f"FROM c{KM.ITERATIONS}), fine AS (SELECT source_id, code, {EVENTS.w} AS w, {EVENTS.step} AS step, CAST({EVENTS.w} AS BIGINT) AS n, "
    f"{Q.r6(Q.lsum('center'))} AS center_sum FROM c{KM.ITERATIONS}) SELECT * FROM coarse UNION ALL SELECT * FROM fine"))
def codebook_store_roundtrip(spark, sf_dir):
    """K7 + S13: two window sizes of one patient, the smaller saved twice; both load, once each, with the centres saved last."""
    path = scratch_dir(spark, "codebooks")
    cb = stored_codebook(spark, sf_dir, EVENTS)
    wide = cb.withColumn("center", F.flatten(F.array("center", "center")))
    WR.save_codebook(cb.withColumn("center", F.transform("center", lambda v: v + 1.0)), path, EVENTS.w, EVENTS.step)
    WR.save_codebook(wide, path, 16, 2)
    WR.save_codebook(cb, path, EVENTS.w, EVENTS.step)
    read = lambda w, step: WR.load_codebook(spark, path, w, step).select(
        "source_id", "code", F.lit(w).alias("w"), F.lit(step).alias("step"), F.size("center").cast("bigint").alias("n"),
        F.round(F.aggregate("center", F.lit(0.0), lambda a, v: a + v), 6).alias("center_sum"))
    return read(EVENTS.w, EVENTS.step).unionByName(read(16, 2))


@register("normalised_windows", _PRE_LI + (
    f" SELECT source_id, frame_ref, k, list_max(win) AS win_max, {Q.lsum('win')} AS win_sum FROM ("
    "SELECT *, list_transform(x, lambda v: (v - avg) / nrm) AS win FROM wstats WHERE nrm <> 0)"))
def normalised_windows(spark, sf_dir):
    """Centred, norm-divided, un-tapered windows, written and read back."""
    path = scratch_dir(spark, "windows")
    WR.normalised_windows(frames_of(spark, sf_dir, LI), LI.w, LI.n).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("source_id", "frame_ref", F.col("k").cast("int").alias("k"), F.array_max("window").alias("win_max"),
                       F.aggregate("window", F.lit(0.0), lambda a, v: a + v).alias("win_sum"))


_EMB = "WITH " + ", ".join(Q.embedding_train_ctes() + Q.lloyd_iter_ctes(64, KM.ITERATIONS))


@register("embedding_codes", _EMB + (
    f", nn AS (SELECT * EXCLUDE (rn) FROM (SELECT t.source_id, t.j, c.code, {Q.sqdist('t.feat', 'c.center', 64)} AS d, "
    f"row_number() OVER (PARTITION BY t.source_id, t.j ORDER BY {Q.sqdist('t.feat', 'c.center', 64)}, c.code) AS rn "
    f"FROM train t JOIN c0 c ON t.source_id = c.source_id) WHERE rn = 1) SELECT source_id, j, code, d FROM nn"))
def embedding_codes(spark, sf_dir):
    """J3 on ready-made 64-dim windows: every embedding's nearest code in its
    label's dictionary (k = 10 % of the label's vectors, evenly spaced by id)."""
    train, budget = embedding_windows(spark, sf_dir)
    book = KM.init_centers(train, budget, 64)
    return KM.assign(train.select("source_id", "j", "feat"), book).select("source_id", "j", "code", "d")


@register("embedding_codebook", _EMB + (
    f" SELECT source_id, code, {Q.r6(Q.lsum('center'))} AS center_sum, "
    f"{Q.r6(Q.lsum('list_transform(center, lambda v: v * v)'))} AS center_sumsq FROM c{KM.ITERATIONS}"))
def embedding_codebook(spark, sf_dir):
    """A13(b) on the embeddings: 20 Lloyd iterations per label, all labels at once."""
    train, budget = embedding_windows(spark, sf_dir)
    cb = KM.lloyd(train.select("source_id", "j", "feat"), budget, 64)
    return cb.select("source_id", "code",
                     F.round(F.aggregate("center", F.lit(0.0), lambda a, v: a + v), 6).alias("center_sum"),
                     F.round(F.aggregate("center", F.lit(0.0), lambda a, v: a + v * v), 6).alias("center_sumsq"))


ML_CODES = 16


@register("codebook_ml", (
    f"WITH v AS (SELECT vec_id, {Q.on_grid('CAST(embedding AS DOUBLE[])')} AS feat FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), "
    f"seeds AS (SELECT feat FROM v ORDER BY vec_id LIMIT {ML_CODES}), "
    f"d AS (SELECT v.vec_id, min(CAST(floor({Q.sqdist('v.feat', 's.feat', 64)} * CAST({KM.GRID} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS q FROM v, seeds s GROUP BY 1) "
    f"SELECT CAST({ML_CODES} AS BIGINT) AS n_codes, CAST(count(*) AS BIGINT) AS n_members, true AS all_finite, "
    "CAST(sum(q) AS BIGINT) AS seeds_cost, true AS costs_less FROM d"))
def codebook_ml(spark, sf_dir):
    """A13(a): ``pyspark.ml`` KMeans (k-means||, seeded, 20 iterations) on all
    embedding vectors as one training set, with a fixed number of codes; its
    seeds depend on partitioning, so what is checked is free of order: codes
    within k, every vector a member of one, finite centres, and a cost below
    that of the first vectors as codes."""
    train, _ = embedding_windows(spark, sf_dir)
    cb = KM.fit_ml_codebook(train, ML_CODES, max_iter=20, seed=1, with_members=True)
    finite = F.forall("center", lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    one = train.select(F.lit(0).alias("source_id"), F.col("vec_id").alias("j"), "feat")
    seeds = one.orderBy("j").limit(ML_CODES).select("source_id", F.monotonically_increasing_id().cast("int").alias("code"), F.col("feat").alias("center"))
    costs = SD.cost(one, seeds).select("source_id", F.col("cost").alias("seeds_cost")).join(
        SD.cost(one, cb.select(F.lit(0).alias("source_id"), "code", "center")), "source_id")
    facts = cb.agg(F.count(F.lit(1)).alias("n_codes"), F.sum("n_members").cast("bigint").alias("n_members"),
                   F.bool_and(finite).alias("all_finite"), F.lit(0).alias("source_id"))
    return facts.join(costs, "source_id").select("n_codes", "n_members", "all_finite", "seeds_cost", (F.col("cost") < F.col("seeds_cost")).alias("costs_less"))


@register("word_preview_filter", _WORDS + (
    " SELECT word, word_count FROM (SELECT * FROM totals ORDER BY word LIMIT 10) WHERE word_count > 100"))
def word_preview_filter(spark, sf_dir):
    """P10 first form: the ``> 100`` filter applied after a 10-row preview
    (the preview is made deterministic: first ten words in word order)."""
    return WD.words_over(totals_of(spark, sf_dir).orderBy("word").limit(10), 100)
