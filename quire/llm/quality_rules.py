"""Robust multivariate outlier rules for documents, in DataFrame and SQL functions only.

Each document has a vector of transformed statistics.  For each language and source, each
language, and the corpus, centre and scatter are estimated by the minimum covariance
determinant.  Concentration steps move from a start to the mean and covariance of the
``SHARE`` of documents that lie nearest, which never raises the determinant.  Three starts
are tried: medians with quartile ranges, and these with the correlations of bounded
deviations and of spatial signs.  The one of least determinant goes on until no estimate
moves, at most ``LAST_STEPS`` more, and a last step takes all documents within the
``INNER`` quantile.

Small groups say little by themselves, so every estimate is a weighted mean with that of
the level above, which counts as ``PRIOR`` documents: sources lean on their language,
languages on the corpus, the corpus on ``SCALES``.  There is no size at which a rule
switches.  Documents beyond ``CUTOFF`` (squared Mahalanobis distance) are rejected.

Vectors are fixed-point longs, so sums are exact and don't depend on the order of tasks.
A step is one aggregation: documents are counted and summed by bin of distance within each
fit, so neither a hot source nor a quantile needs the rows of a group in one place.  The
nearest share is that of whole bins (a ``BIN``th of a standard deviation wide) up to the one
that reaches it, as documents at one distance can't be told apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._frames import col, table
from quire.llm._scratch import Scratch, small_join

DIMS = 5
UNIT = 1024
SHARE, STEPS, LAST_STEPS = 0.75, 2, 4
PRIOR = 2.0 * DIMS + 1
#: Standard deviations that are taken for the corpus before any document is seen; no start is below them and no
#: estimate below half of them.  Repetitions are mostly 0, so their scatter is often this: beyond 36% duplicate
#: lines or 23% repeated words in a source that has none, one statistic alone passes CUTOFF.
SCALES = (0.2, 0.6, 0.2, 0.16, 1.2)
BINS, BIN = 16384, 64


def _chi2(x: float, dims: int) -> float:
    """The chi-square distribution for an odd number of dimensions."""
    term, total = 1.0, 0.0
    for k in range(1, dims - 1, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total


def _quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, dims) < p else (lo, mid)
    return lo


#: Factors that make the scatter of the nearest share consistent for normal data.
HALF = SHARE / _chi2(_quantile(SHARE, DIMS), DIMS + 2)
INNER = _quantile(0.975, DIMS)
LAST = 0.975 / _chi2(INNER, DIMS + 2)
#: The quantile 1 - 1e-6.
CUTOFF = _quantile(1 - 1e-6, DIMS)

WORD = r"[\x20\x09-\x0D]"
GAPS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"

#: The statistics, the same in Spark and in the oracle; n_words is at least 50 there.
VECTOR = (
    "ln(1.0e0 + word_chars / CAST(n_words AS DOUBLE))",
    "ln(1.0e0 + 100.0e0 * n_symbols / CAST(word_chars AS DOUBLE))",
    "sqrt(n_dup_lines / CAST(n_lines AS DOUBLE))",
    "sqrt(n_repeat_words / CAST(n_words AS DOUBLE))",
    "ln(CAST(n_words AS DOUBLE))",
)
V = [f"v{j}" for j in range(DIMS)]
FIXED = [f"CAST(floor({UNIT}.0e0 * {x} + 0.5e0) AS BIGINT) AS {v}" for x, v in zip(VECTOR, V, strict=True)]
FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
TRIANGLE = [(j, k) for j in range(DIMS) for k in range(j + 1)]
SUMS = ["count(*) AS n", *[f"sum({v}) AS s_{v}" for v in V], *[f"sum({V[j]} * {V[k]}) AS s_{V[j]}{V[k]}" for j, k in TRIANGLE]]
SUMMED = [x.rpartition(" ")[2] for x in SUMS]
M, C, L = [f"m{j}" for j in range(DIMS)], [f"c{j}{k}" for j, k in TRIANGLE], [f"l{j}{k}" for j, k in TRIANGLE]
STARTS = 3


def _least(j: int) -> float:
    return (SCALES[j] * UNIT) ** 2 * 0.25


def _quartered() -> list[str]:
    """From quartiles q_v0.. (arrays): medians and scales."""
    return [*[f"q_{v}[QMID] AS m{j}" for j, v in enumerate(V)], *[f"greatest((q_{v}[QTOP] - q_{v}[QLOW]) / 1.349e0, {SCALES[j] * UNIT}e0) AS e{j}" for j, v in enumerate(V)]]


def _deviations(keep: list[str]) -> list[list[str]]:
    """Projections from vectors beside medians and scales to bounded deviations t0.. and spatial signs u0.., as longs."""
    z = [f"(v{j} - m{j}) / e{j} AS z{j}" for j in range(DIMS)]
    norm = "sqrt(" + " + ".join(f"z{j} * z{j}" for j in range(DIMS)) + ") AS norm"
    fixed = lambda x, name: f"CAST(floor({UNIT}.0e0 * {x} + 0.5e0) AS BIGINT) AS {name}"
    zs = [f"z{j}" for j in range(DIMS)]
    return [[*keep, *z], [*keep, *zs, norm], [*keep, *[fixed(f"z{j} / (1.0e0 + abs(z{j}))", f"t{j}") for j in range(DIMS)], *[fixed(f"(z{j} / greatest(norm, 1.0e-9))", f"u{j}") for j in range(DIMS)]]]


DEVIATED = [f"sum({x}{j} * {x}{k}) AS s_{x}{j}{k}" for x in "tu" for j, k in TRIANGLE]


def _starts() -> list[list[str]]:
    """For each start, columns from medians, scales and summed deviations: start, centre and scatter."""
    out = [["0 AS start", *M, *[f"e{j} * e{j} AS c{j}{j}" if j == k else f"0.0e0 AS c{j}{k}" for j, k in TRIANGLE]]]
    for n, x in enumerate("tu", 1):
        root = lambda j, x=x: f"sqrt(greatest(CAST(s_{x}{j}{j} AS DOUBLE), 1.0e0))"
        out.append([f"{n} AS start", *M, *[f"e{j} * e{j} AS c{j}{j}" if j == k else f"e{j} * e{k} * (CAST(s_{x}{j}{k} AS DOUBLE) / ({root(j)} * {root(k)})) AS c{j}{k}" for j, k in TRIANGLE]])
    return out


def _moments(keys: list[str], factor: float) -> list[list[str]]:
    """Projections from sums to n, means and scatter."""
    d = "CAST({} AS DOUBLE)".format
    return [
        [*keys, "n", *[f"{d(f's_{v}')} / {d('n')} AS m{j}" for j, v in enumerate(V)], *SUMMED[1 + DIMS :]],
        [*keys, "n", *M, *[f"{factor!r}e0 * ({d(f's_{V[j]}{V[k]}')} / {d('n')} - m{j} * m{k}) AS c{j}{k}" for j, k in TRIANGLE]],
    ]


def _factored(keys: list[str]) -> list[list[str]]:
    """Projections, one upon another, from centre and scatter to a state: with the scatter's Cholesky factor and its determinant's log."""
    steps, have = [], [*keys, *M, *C]
    for j, k in TRIANGLE:
        ridge = f" + {_least(j)!r}e0" if j == k else ""
        left = f"c{j}{k}{ridge}" + "".join(f" - l{j}{i} * l{k}{i}" for i in range(k))
        made = f"sqrt(greatest({left}, {_least(j)!r}e0)) AS l{j}{j}" if j == k else f"({left}) / l{k}{k} AS l{j}{k}"
        steps.append([*have, made])
        have = [*have, f"l{j}{k}"]
    steps.append([*keys, *M, *L, " + ".join(f"ln(l{j}{j})" for j in range(DIMS)) + " AS det"])
    return steps


def _leaned(keys: list[str]) -> list[str]:
    """n, means and scatter as weighted means with those of the level above, which have pm0.. and pc00.. as names."""
    mean = lambda x: f"(n * {x} + {PRIOR!r}e0 * p{x}) / (n + {PRIOR!r}e0) AS {x}"
    return [*keys, *[mean(x) for x in [*M, *C]]]


#: What the corpus leans on: its own means, and SCALES.
ABOVE = [*[f"{m} AS p{m}" for m in M], *[f"{(SCALES[j] * UNIT) ** 2!r}e0 AS pc{j}{k}" if j == k else f"0.0e0 AS pc{j}{k}" for j, k in TRIANGLE]]


def _distance(keep: list[str]) -> list[list[str]]:
    """Projections from vectors beside a state to d2, the squared distance."""
    steps, have = [], [*keep, *V, *M, *L]
    for j in range(DIMS):
        left = f"(v{j} - m{j})" + "".join(f" - l{j}{k} * y{k}" for k in range(j))
        steps.append([*have, f"({left}) / l{j}{j} AS y{j}"])
        have = [*have, f"y{j}"]
    steps.append([*keep, *V, " + ".join(f"y{j} * y{j}" for j in range(DIMS)) + " AS d2"])
    return steps


def _project(df: DataFrame, steps: list[list[str]]) -> DataFrame:
    for step in steps:
        df = df.selectExpr(*step)
    return df


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the base columns and n_lines after the others."""
    keep = [c for c in docs.columns if c != text_col]
    df = docs.select(*keep, F.coalesce(col(docs, text_col).cast("string"), F.lit("")).alias("_t"))
    df = df.select(*keep, "_t", F.filter(F.split("_t", WORD + "+"), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", GAPS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).alias("_h"),
    )
    stats = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    # windows found again: their places, by neighbours in the sorted windows
    df = df.select(*stats, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    same = F.zip_with(F.slice("_s", 1, F.size("_s") - 1), F.slice("_s", 2, F.size("_s") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.select(*stats, F.when(F.col("_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))).alias("_p"))
    steps = F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.aggregate(steps, F.lit(3), lambda n, x: n + x)
    return df.select(*stats, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _level(n: int, *keys: str) -> F.Column:
    return F.concat_ws("|", F.lit(str(n)), *[F.coalesce(F.md5(F.col(k).cast("string")), F.lit("-")) for k in keys])


def _aggs(sums: list[str]) -> list:
    return [F.expr(x.partition(" AS ")[0]).alias(x.rpartition(" ")[2]) for x in sums]


def _fits(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """From (key, v0..): for each key n, means and scatter by the minimum covariance determinant."""
    quartiles = vectors.groupBy("key").agg(*[F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{v}") for v in V])
    scales = scratch.stage(quartiles.selectExpr("key", *[x.replace("QLOW", "0").replace("QMID", "1").replace("QTOP", "2") for x in _quartered()]), "scales")
    deviated = _project(small_join(vectors, scratch, "scales", scales, "key", "inner"), _deviations(["key"])).groupBy("key").agg(*_aggs(DEVIATED))
    told = scratch.stage(scales.join(deviated, "key"), "deviated")
    state = None
    for start in _starts():
        one = told.selectExpr("key", *start)
        state = one if state is None else state.unionByName(one)
    state = scratch.stage(_project(state, _factored(["key", "start"])), "state0")
    both = ["key", "start"]
    for step in range(1, STEPS + LAST_STEPS + 1):
        far = _project(small_join(vectors, scratch, f"state{step - 1}", state, "key", "inner"), _distance(both))
        bins = far.withColumn("bin", F.least(F.floor(F.sqrt("d2") * BIN), F.lit(BINS - 1))).groupBy(*both, "bin").agg(*_aggs(SUMS))
        bins = bins.selectExpr("*", "sum(n) OVER (PARTITION BY key, start ORDER BY bin) - n AS before", "sum(n) OVER (PARTITION BY key, start) AS total")
        near = bins.filter(f"before < {SHARE} * total").groupBy(*both).agg(*[F.sum(x).alias(x) for x in SUMMED])
        moved = _project(_project(near, _moments(both, HALF)), _factored(both))
        if step == STEPS:  # the start of least determinant goes on
            moved = moved.groupBy("key").agg(F.min_by(F.struct("start", *M, *L, "det"), F.struct("det", "start")).alias("best")).select("key", "best.*")
        last, state = state, scratch.stage(moved, f"state{step}")
        if step > STEPS and state.join(last.select("key", F.col("det").alias("was")), "key").filter("det <> was").isEmpty():
            break
    far = _project(small_join(vectors, scratch, f"state{step}", state, "key", "inner"), _distance(["key"]))
    near = far.filter(f"d2 <= {INNER!r}").groupBy("key").agg(*_aggs(SUMS))
    return scratch.stage(_project(near, _moments(["key"], LAST)), "moments")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and distance2.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Null or empty text: no words, rejected by the base
    rule.  A null language or source is one of its own.  Null and repeated ids keep their
    rows, each judged by its own text; equal rows get equal verdicts and all count.  A very
    long text is one row's work.  Ties (documents at one distance) are treated alike.  Other
    columns are not read.  An empty table gives no rows.  distance2 is null where the base
    rule rejects.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    named = docs.select(col(docs, id_col).alias("id"), col(docs, lang_col).alias("lang"), col(docs, source_col).alias("source"), col(docs, text_col).alias("text"))
    stats = base_statistics(named).withColumn("base_failed", F.expr(FAILED))
    stats = stats.select("*", _level(1, "lang").alias("lk"), _level(2, "lang", "source").alias("sk"))
    stats = scratch.stage(stats, "stats")
    good = stats.filter(~F.col("base_failed"))
    vectors = scratch.stage(good.selectExpr("lk", "sk", *FIXED).select(F.explode(F.array(F.lit("0"), "lk", "sk")).alias("key"), *V), "vectors")
    moments = _fits(vectors, scratch)

    # each level leans on the one above
    levels = scratch.stage(good.select("lk", "sk").distinct(), "levels")
    above = lambda df: df.select(F.col("key").alias("up"), *[F.col(x).alias(f"p{x}") for x in [*M, *C]])
    corpus = moments.filter("key = '0'").selectExpr("*", *ABOVE).selectExpr(*_leaned(["key"]))
    langs = levels.select(F.col("lk").alias("key"), F.lit("0").alias("up")).distinct().join(moments, "key").join(above(corpus), "up").selectExpr(*_leaned(["key"]))
    langs = scratch.stage(langs, "langs")
    sources = levels.select(F.col("sk").alias("key"), F.col("lk").alias("up")).join(moments, "key").join(above(langs), "up").selectExpr(*_leaned(["key"]))
    state = scratch.stage(_project(sources, _factored(["key"])).withColumnRenamed("key", "sk"), "state")

    judged = stats.selectExpr("*", *[f"CASE WHEN NOT base_failed THEN {x.rpartition(' AS ')[0]} END AS {v}" for x, v in zip(FIXED, V, strict=True)])
    judged = small_join(judged, scratch, "state", state, "sk", "left")
    base = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = _project(judged, _distance(base))
    scratch.drop("vectors")
    return judged.select(F.col("id").alias(id_col), *base[1:], (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)).alias("kept"), F.col("d2").alias("distance2"))


def query(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("distance2")


def _oracle() -> str:
    ctes: list[str] = []

    def add(name: str, sql: str) -> str:
        ctes.append(f"{name} AS MATERIALIZED ({sql})")
        return name

    def project(name: str, source: str, steps: list[list[str]]) -> str:
        for i, step in enumerate(steps):
            source = add(f"{name}_{i}", f"SELECT {', '.join(step)} FROM {source}")
        return source

    add("t", "SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents")
    add("w", r"SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t")
    add("g", "SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3")
    add("g2", "SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g")
    add("rep", "SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE c > 1) GROUP BY r")
    add(
        "b",
        r"""SELECT doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)""",
    )
    add("stats", f"SELECT *, {FAILED} AS base_failed, '1' || coalesce('+' || lang, '-') AS lk, '2' || coalesce('+' || lang, '-') || '|' || coalesce('+' || source, '-') AS sk FROM b")
    add("vectors", f"SELECT unnest(['0', lk, sk]) AS key, {', '.join(V)} FROM (SELECT lk, sk, {', '.join(FIXED)} FROM stats WHERE NOT base_failed)")
    add("q", "SELECT key, " + ", ".join(f"quantile_cont({v}, [0.25, 0.5, 0.75]) AS q_{v}" for v in V) + " FROM vectors GROUP BY key")
    add("scales", "SELECT key, " + ", ".join(_quartered()).replace("QLOW", "1").replace("QMID", "2").replace("QTOP", "3") + " FROM q")
    z = project("z", "vectors JOIN scales USING (key)", _deviations(["key"]))
    add("told", f"SELECT * FROM scales JOIN (SELECT key, {', '.join(DEVIATED)} FROM {z} GROUP BY key) USING (key)")
    add("starts", " UNION ALL ".join(f"SELECT key, {', '.join(x)} FROM told" for x in _starts()))
    state = project("s0", "starts", _factored(["key", "start"]))
    for step in range(1, STEPS + LAST_STEPS + 1):
        far = project(f"d{step}", f"vectors JOIN {state} USING (key)", _distance(["key", "start"]))
        add(f"bins{step}", f"SELECT key, start, least(floor(sqrt(d2) * {BIN}), {BINS - 1}) AS bin, {', '.join(SUMS)} FROM {far} GROUP BY ALL")
        add(f"cum{step}", f"SELECT *, sum(n) OVER (PARTITION BY key, start ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY key, start) AS total FROM bins{step}")
        near = add(f"near{step}", f"SELECT key, start, {', '.join(f'sum({x}) AS {x}' for x in SUMMED)} FROM cum{step} WHERE before < {SHARE} * total GROUP BY key, start")
        state = project(f"s{step}", project(f"m{step}", near, _moments(["key", "start"], HALF)), _factored(["key", "start"]))
        if step == STEPS:
            state = add("best", f"SELECT * FROM {state} QUALIFY row_number() OVER (PARTITION BY key ORDER BY det, start) = 1")
    far = project("last", f"vectors JOIN {state} USING (key)", _distance(["key"]))
    moments = project("mm", add("inner_", f"SELECT key, {', '.join(SUMS)} FROM {far} WHERE d2 <= {INNER!r} GROUP BY key"), _moments(["key"], LAST))
    add("levels", "SELECT DISTINCT lk, sk FROM stats WHERE NOT base_failed")
    above = lambda source: f"(SELECT key AS up, {', '.join(f'{x} AS p{x}' for x in [*M, *C])} FROM {source})"
    add("corpus", f"SELECT {', '.join(_leaned(['key']))} FROM (SELECT *, {', '.join(ABOVE)} FROM {moments} WHERE key = '0')")
    add("langs", f"SELECT {', '.join(_leaned(['key']))} FROM (SELECT DISTINCT lk AS key, '0' AS up FROM levels) JOIN {moments} USING (key) JOIN {above('corpus')} USING (up)")
    add("sources", f"SELECT {', '.join(_leaned(['key']))} FROM (SELECT sk AS key, lk AS up FROM levels) JOIN {moments} USING (key) JOIN {above('langs')} USING (up)")
    state = project("state", "sources", _factored(["key"]))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    vs = ", ".join(f"CASE WHEN NOT base_failed THEN {x.rpartition(' AS ')[0]} END AS {v}" for x, v in zip(FIXED, V, strict=True))
    add("judged", f"SELECT * FROM (SELECT stats.*, sk AS key, {vs} FROM stats) LEFT JOIN {state} USING (key)")
    last = project("j", "judged", _distance(base))
    return f"WITH {', '.join(ctes)} SELECT {', '.join(base)}, NOT base_failed AND coalesce(d2, 0) <= {CUTOFF!r} AS kept FROM {last}"


ORACLE = _oracle()
