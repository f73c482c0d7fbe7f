"""Mixing of sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts by cell (source, language, topic) are raked: sweep by sweep the cells are
scaled to the target share of each source, of each language and of each topic, until the
largest error of a margin is under ``TOLERANCE``.  A document is then sampled with the
calibrated probability budget * weight / tokens of its cell.  Raking is bounded: a cell of
which all tokens are taken is held there and the rest is raked to what remains; a margin's
value with fewer tokens than its target is taken whole and the others share what it leaves.
``margins`` holds targets against what is reached.  A draw is a hash of the seed and its
id, so a run can be repeated anywhere.

The cells are one aggregation of the corpus; all raking happens on that small table, and
the probabilities come back by a join that is broadcast only if the table is small.
What the driver asks on the way it asks of all margins at once, in one scan: every job and
every scan costs it a broadcast block of ``spark.broadcast.blockSize``, however small the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._frames import col, fresh, table
from quire.llm._scratch import Scratch, small_join

#: Where no targets are given, that of a margin's value is its share of the tokens to this power, normalised.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SWEEPS, BUDGET, SEED = 12, 0.5, "quire"
TOLERANCE = 1e-10
STAGED = 4
#: Up to so many cells are raked in one task; more are spread by the margin at hand.
ONE_TASK = 20_000


def topic_of(text: Column) -> Column:
    """The genre of a text by what fills it: markup, table, numeric, legal, brief or prose."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    share = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / F.greatest(F.length(t), F.lit(1))
    return (
        F.when(share("#*$%&<>{}") > 0.05, "markup")
        .when(share("|") > 0.02, "table")
        .when(share("0123456789") > 0.03, "numeric")
        .when(t.rlike("(?i)licen[cs]e|copyright|warrant"), "legal")
        .when(F.length(t) < 600, "brief")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(id_: Column, seed: str) -> Column:
    """A number in [0, 1) from the seed and an id; a null id draws as a value of its own."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _key(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), c.cast("string")))


def _by_margin(cells: DataFrame, margins, **also: Callable[[str], Column]) -> DataFrame:
    """A row for each cell and margin: the cell's numbers, margin, value, and ``also``, columns by margin."""
    rows = [F.struct(F.lit(m).alias("margin"), F.col(m).alias("value"), *[of(m).alias(k) for k, of in also.items()]) for m in margins]
    numbers = [c for c in ("tokens", "weight", "bound") if c in cells.columns]
    return cells.select(*numbers, F.explode(F.array(*rows)).alias("row")).select(*numbers, "row.*")


def _reachable(values: DataFrame) -> dict[str, tuple[float, float]]:
    """From (margin, goal, cap): by margin the sum of its goals, and the factor to goals over that sum by which
    least(cap, factor * goal) sum to 1; infinite if all caps are needed."""
    told = lambda by, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in by.items() for x in pair]), F.col("margin")), F.lit(default))
    wanted = {r.margin: r.wanted or 1.0 for r in values.groupBy("margin").agg(F.sum("goal").alias("wanted")).collect()}
    factors, found = dict.fromkeys(wanted, 1.0), {}
    while factors:
        # a row of numbers for each margin is all that the driver sees
        goals = values.filter(F.col("margin").isin(*factors)).withColumn("goal", F.col("goal") / told(wanted, 1.0))
        full = F.col("cap") <= told(factors, 1.0) * F.col("goal")
        sums = goals.groupBy("margin").agg(F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("goal"))).alias("free")).collect()
        for r in sums:
            factor = factors.pop(r.margin)
            more = (1.0 - (r.held or 0.0)) / r.free if r.free else float("inf")
            if not r.free or more <= factor * (1 + 1e-12):  # the full ones only grow, so this ends
                found[r.margin] = wanted[r.margin], factor if r.free else more
            else:
                factors[r.margin] = more
    return found


def _raked(m: str) -> Column:
    """The weight scaled to the goal of ``m``, with cells at their bound held there."""
    by = Window.partitionBy(m)
    full, goal = F.col("weight") >= F.col("bound"), F.col(f"goal_{m}")
    now = F.sum(F.least("weight", "bound")).over(by)
    held, free = F.sum(F.when(full, F.col("bound")).otherwise(0.0)).over(by), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(by)
    grown = F.when(~full & (goal > held) & (free > 0), F.col("weight") * ((goal - held) / free)).otherwise(F.col("weight"))
    return F.when(now > goal, F.col("weight") * (goal / now)).otherwise(grown)


def _wanted(m: str, had: Column, exponents: dict[str, float], targets: dict, value: Column | None = None) -> Column:
    """The target weight of a margin's value (``m`` unless given), before it is normalised; ``had`` is its share of the tokens."""
    if m not in targets:
        return F.pow(had, F.lit(exponents[m]))
    told = [x for value, weight in targets[m].items() for x in (F.lit("-" if value is None else "+" + str(value)), F.lit(float(weight)))]
    return F.coalesce(F.try_element_at(F.create_map(*told), F.col(m) if value is None else value), F.lit(0.0)) if told else F.lit(0.0)


def calibrated(cells: DataFrame, scratch: Scratch, exponents: dict[str, float] = EXPONENTS, targets: dict | None = None, sweeps: int = SWEEPS, budget: float = BUDGET) -> DataFrame:
    """From cells (source, lang, topic, tokens): those with a target, with weight and probability."""
    count, whole = cells.agg(F.count("*"), F.sum("tokens")).first()
    small, whole = count <= ONE_TASK, float(whole or 0)
    if small:
        cells = cells.coalesce(1)  # one task needs no shuffle for any margin
    targets = targets or {}
    for m in targets:
        cells = cells.filter(_wanted(m, F.lit(0.0), exponents, targets) > 0)
    state = cells.withColumn("total", F.lit(whole))
    if whole:
        share = lambda had: had.cast("double") / whole
        values = _by_margin(cells, exponents).groupBy("margin", "value").agg(share(F.sum("tokens")).alias("had"))
        goal = F.coalesce(*[F.when(F.col("margin") == m, _wanted(m, F.col("had"), exponents, targets, F.col("value"))) for m in exponents])
        reached = _reachable(values.select("margin", goal.alias("goal"), (F.col("had") / budget).alias("cap")))
        for m in exponents:
            wanted, factor = reached.get(m, (1.0, float("inf")))
            had = share(F.sum("tokens").over(Window.partitionBy(m)))
            state = state.withColumn(f"goal_{m}", F.least(had / budget, F.lit(factor) * (_wanted(m, had, exponents, targets) / wanted)))
    if not whole:
        state = state.withColumns({f"goal_{m}": F.lit(0.0) for m in exponents})
    state = state.withColumn("bound", F.col("tokens") / (F.col("total") * F.lit(budget)))
    state = scratch.stage(state.withColumn("weight", F.col("tokens") / F.col("total")), "goals")
    for sweep in range(sweeps):
        if small and sweep % STAGED == 0:
            state = state.coalesce(1)
        for m in exponents:
            state = state.withColumn("weight", _raked(m))
        if sweep % STAGED == STAGED - 1 or sweep == sweeps - 1:
            state = scratch.stage(state, f"sweep{sweep}")
            if _error(state.coalesce(1) if small else state, exponents) < TOLERANCE:
                break
    return state.withColumn("probability", F.least(F.lit(1.0), F.lit(budget) * F.col("total") * F.col("weight") / F.col("tokens")))


def _error(state: DataFrame, exponents: dict[str, float]) -> float:
    """The largest difference of a margin's value from its goal."""
    off = F.abs(F.sum(F.least("weight", "bound")) - F.first("goal")).alias("off")
    return _by_margin(state, exponents, goal=lambda m: F.col(f"goal_{m}")).groupBy("margin", "value").agg(off).agg(F.max("off")).first()[0] or 0.0


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, dict[str | None, float]] | None = None,
    exponents: dict[str, float] = EXPONENTS,
    sweeps: int = SWEEPS,
    budget: float = BUDGET,
    seed: str = SEED,
) -> DataFrame:
    """The columns of ``docs`` but the text, and n_tokens, topic, probability and sampled.

    ``targets`` are weights by margin ("source", "lang", "topic") and value, None for null,
    normalised over the values that occur; a value without one is never sampled.  A margin
    that it doesn't name has the powers of ``exponents``.  ``budget`` is the share of all
    tokens to sample; where targets can't fill it, all that they can reach is taken.

    The added names get underscores before them where ``docs`` has them already.  Null
    sources and languages are values of their own.  Texts without words (null, empty) have
    no tokens, so nothing to weigh: probability 0.  Equal ids draw alike, so repeated rows
    are sampled together, and rows of a null id too.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = col(docs, text_col)
    names = [fresh(docs, x) for x in ("n_tokens", "topic", "probability", "sampled")]
    keys = [fresh(docs, x) for x in ("mix_source", "mix_lang", "mix_topic")]
    n_tokens, topic_name, probability, sampled = names
    rest = [c for c in docs.columns if c != text_col]
    # the texts are read once; what they say is a narrow table
    facts = docs.select(
        *[col(docs, c) for c in rest],
        token_count(text).alias(n_tokens),
        (topic_of(text) if topic is None else topic).alias(topic_name),
        _key(col(docs, source_col)).alias(keys[0]),
        _key(col(docs, lang_col)).alias(keys[1]),
    ).withColumn(keys[2], _key(F.col(topic_name)))
    facts = scratch.stage(facts, "facts")
    cells = facts.groupBy(*[F.col(k).alias(m) for k, m in zip(keys, exponents, strict=True)]).agg(F.sum(n_tokens).alias("tokens")).filter("tokens > 0")
    fitted = scratch.stage(calibrated(scratch.stage(cells, "cells"), scratch, exponents, targets, sweeps, budget), "fitted")
    chances = fitted.select(*[F.col(m).alias(k) for k, m in zip(keys, exponents, strict=True)], F.col("probability").alias(probability))
    rows = small_join(facts, scratch, "fitted", chances, keys, "left")
    chance = F.when(F.col(n_tokens) > 0, F.coalesce(F.col(probability), F.lit(0.0))).otherwise(0.0)
    rows = rows.select(*[F.col("`" + c.replace("`", "``") + "`") for c in rest], n_tokens, topic_name, chance.alias(probability))
    return rows.withColumn(sampled, draw(F.col("`" + id_col + "`"), seed) < F.col(probability))


def margins(mixed: DataFrame, exponents: dict[str, float] = EXPONENTS, targets: dict | None = None) -> DataFrame:
    """Of rows from ``mix``, by margin and value: had (share of the tokens), target, expected and sampled (shares of the
    sample's tokens), and fill (the expected sample in tokens, of all tokens)."""
    out = None
    tokens, chance = F.col("n_tokens"), F.col("n_tokens") * F.col("probability")
    for m in exponents:
        one = mixed.groupBy(F.col(m).cast("string").alias("value")).agg(F.sum(tokens).alias("had"), F.sum(chance).alias("expected"), F.sum(F.when(F.col("sampled"), tokens).otherwise(0)).alias("sampled"))
        one = one.filter("had > 0").withColumn("share", F.col("had") / F.sum("had").over(Window.partitionBy()))  # a row for each value
        one = one.withColumn(m, _key(F.col("value"))).withColumn("target", _wanted(m, F.col("share"), exponents, targets or {})).drop("share", m)
        one = one.withColumn("margin", F.lit(m))
        out = one if out is None else out.unionByName(one)
    by = Window.partitionBy("margin")
    out = out.withColumn("fill", F.sum("expected").over(by) / F.sum("had").over(by))
    out = out.withColumns({c: F.col(c) / F.sum(c).over(by) for c in ("had", "target", "expected", "sampled")})
    return out.select("margin", "value", "had", "target", "expected", "sampled", "fill")


def query(spark, sf_dir):
    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def _oracle() -> str:
    """The same by other means: goals from prefix sums over values in order of cap / goal, margins by grouped joins."""
    share = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g')) / CAST(greatest(length(t), 1) AS DOUBLE)"
    ctes = [
        "d AS MATERIALIZED (SELECT *, coalesce(text, '') AS t FROM documents)",
        f"""facts AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN {share('#*$%&<>{}')} > 0.05 THEN 'markup' WHEN {share('|')} > 0.02 THEN 'table'
        WHEN {share('0-9')} > 0.03 THEN 'numeric' WHEN regexp_matches(t, '(?i)licen[cs]e|copyright|warrant') THEN 'legal' WHEN length(t) < 600 THEN 'brief' ELSE 'prose' END AS topic,
        CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM d)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens, sum(sum(n_tokens)) OVER () AS total FROM facts GROUP BY source, lang, topic HAVING sum(n_tokens) > 0)",
    ]
    for m, p in EXPONENTS.items():
        ctes.append(f"want_{m} AS MATERIALIZED (SELECT {m}, pow(had, {p}) / sum(pow(had, {p})) OVER () AS goal, had / {BUDGET} AS cap FROM (SELECT {m}, sum(tokens) / CAST(any_value(total) AS DOUBLE) AS had FROM cells GROUP BY {m}))")
        # in order of cap / goal the first values are taken whole; the factor is that of the first one that isn't
        ctes.append(
            f"""fill_{m} AS MATERIALIZED (SELECT min_by(f, r) AS factor FROM (SELECT cap / goal AS r,
            (1 - coalesce(sum(cap) OVER (ORDER BY cap / goal, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(goal) OVER (ORDER BY cap / goal, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM want_{m}) WHERE r > f)"""
        )
        ctes.append(f"goal_{m} AS MATERIALIZED (SELECT {m}, coalesce(least(cap, factor * goal), cap) AS goal FROM want_{m}, fill_{m})")
    ctes.append(f"s0 AS MATERIALIZED (SELECT *, tokens / CAST(total AS DOUBLE) AS weight, tokens / (CAST(total AS DOUBLE) * {BUDGET}) AS bound FROM cells)")
    n = 0
    for _ in range(SWEEPS):
        for m in EXPONENTS:
            ctes.append(
                f"""s{n + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN now > goal THEN x.weight * goal / now WHEN x.weight < x.bound AND goal > held AND free > 0 THEN x.weight * (goal - held) / free ELSE x.weight END AS weight)
                FROM s{n} x JOIN (SELECT a.{m} AS k, any_value(g.goal) AS goal, sum(least(a.weight, a.bound)) AS now, sum(CASE WHEN a.weight >= a.bound THEN a.bound ELSE 0 END) AS held, sum(CASE WHEN a.weight < a.bound THEN a.weight ELSE 0 END) AS free
                FROM s{n} a JOIN goal_{m} g ON a.{m} IS NOT DISTINCT FROM g.{m} GROUP BY a.{m}) f ON x.{m} IS NOT DISTINCT FROM f.k)"""
            )
            n += 1
    return f"""WITH {', '.join(ctes)}, p AS (SELECT f.*, CASE WHEN n_tokens > 0 THEN coalesce(least(1.0, {BUDGET} * total * weight / tokens), 0.0) ELSE 0.0 END AS probability
      FROM facts f LEFT JOIN s{n} c ON f.source IS NOT DISTINCT FROM c.source AND f.lang IS NOT DISTINCT FROM c.lang AND f.topic = c.topic)
    SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability,
      CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) / 281474976710656.0e0 < probability AS sampled FROM p"""


ORACLE = _oracle()
