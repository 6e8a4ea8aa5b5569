"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token masses are raked: each
margin in turn is scaled to its target until all fit. A document's chance to be sampled is its
cell's ratio of target to actual mass, times one factor that meets the token budget.

Only cells are shuffled and raked, after counting in each task; documents meet their cell's chance
in one join of narrow rows.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from logwarden.session import discard, materialize

MARGINS = ("source", "lang", "topic")
#: Target shares of a margin are its token shares to these powers, made to add up to 1: below 1
#: small categories gain on large ones.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS, BUDGET, STEPS = 8, 0.5, 64
#: Raking takes ``ROUNDS`` rounds at least, and goes on until no margin is further off its target than this share of it,
#: or, with a warning, once ``STALLED`` rounds bring no margin nearer or after ``MOST``.
TOLERANCE, STALLED, MOST = 1e-4, 20, 10_000


def n_words(text: Column) -> Column:
    """Words of a text as its token mass: runs of other than space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_column: str) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _margin(cells: DataFrame, column: str, value: str) -> DataFrame:
    return cells.groupBy(column).agg(F.sum(value).alias("now"))


def _misfit(cells: DataFrame, columns: list[str]) -> float:
    """How far off its target a margin is at most, as a share of the target."""
    off = [cells.groupBy(c).agg(F.sum("fit").alias("now"), F.first(f"want_{c}").alias("want")).select(F.abs(F.col("now") / F.col("want") - 1).alias("off"))
           for c in columns]
    return reduce(DataFrame.unionAll, off).agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (margins..., mass) with ``fit``: masses raked to the targets, in shares of 1.

    Each step divides by the sums of one margin; each round is written. After ``rounds`` rounds
    they go on until every margin is within ``tolerance`` of its target. Where no masses of the given
    cells meet all targets, as when a source and a language have only each other, rounds end when
    they bring no margin nearer, and a warning tells the misfit. Cells without mass stay at 0.
    """
    total = cells.agg(F.sum("mass")).first()[0] or 1
    now = materialize(cells.where("mass > 0").withColumn("fit", F.col("mass") / float(total)), "cells")
    aimed = now
    for column, power in powers.items():
        share = _margin(now, column, "fit").withColumn("p", F.pow("now", F.lit(power)))
        whole = share.agg(F.sum("p")).first()[0] or 1.0
        aimed = aimed.join(share.select(column, (F.col("p") / whole).alias(f"want_{column}")), column)
    aimed = materialize(aimed, "cells")
    discard(now)
    now, done, best, gained = aimed, 0, float("inf"), 0
    while True:
        if done >= rounds:
            off = _misfit(now, list(powers))
            if off <= tolerance:
                break
            if off < best * 0.999:
                best, gained = off, done
            if done - gained >= STALLED or done >= MOST:
                warnings.warn(f"raking ends after {done} rounds with a margin {off:.3%} off its target", RuntimeWarning, stacklevel=2)
                break
        then = now
        for column in powers:
            then = then.withColumn("fit", F.col("fit") * F.col(f"want_{column}") / F.sum("fit").over(Window.partitionBy(column)))
        then = materialize(then, "cells")
        discard(now)
        now = then
        done += 1
    return now.select(*cells.columns, "fit")


def calibrate(raked: DataFrame, budget: float, steps: int = STEPS) -> DataFrame:
    """Cells with ``weight`` (target over actual share) and ``chance``: weight times the factor with
    which, no chance being over 1, the expected sample has ``budget`` of all tokens.

    The factor lies on a grid that two aggregations narrow down.
    """
    total = raked.agg(F.sum("mass"), F.max(F.col("fit") / F.col("mass"))).first()
    mass, most = float(total[0] or 1), float(total[1] or 1) * float(total[0] or 1)
    weighted = raked.withColumn("weight", F.col("fit") * mass / F.col("mass"))
    low, high = 0.0, max(1.0, budget) * 1e6 / max(most, 1e-12)
    for turn in range(4):
        # The first grid is geometric: the factor may be far below its bound.
        grid = [high * (1e-12 ** (1 - (i + 1) / steps)) if turn == 0 else low + (high - low) * (i + 1) / steps for i in range(steps)]
        sums = weighted.agg(*[F.sum(F.least(F.lit(1.0), F.col("weight") * c) * F.col("mass")).alias(f"s{i}") for i, c in enumerate(grid)]).first()
        over = next((i for i, s in enumerate(sums) if (s or 0.0) >= budget * mass), steps - 1)
        low, high = (grid[over - 1] if over else low), grid[over]
    return weighted.withColumn("chance", F.least(F.lit(1.0), F.col("weight") * high))


def with_topics(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Adds ``topic``: the cluster label of the vector with the document's id, ``none`` without one.

    An id with several labels takes the smallest.
    """
    topics = embeddings.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("doc_id")).agg(F.min("label").cast("string").alias("topic"))
    return docs.join(topics, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit("none")))


def mix(docs: DataFrame, embeddings: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, chance, keep) of every row.

    ``chance`` is the calibrated probability and ``keep`` the draw, fixed by the id: rows of one id
    share it, and equal chances keep the ids of smaller numbers. A null or empty source or
    language is the category ``none``. Texts without words have no mass: weight 1 and the
    budget as chance. A ``topic`` column that the documents bring along isn't used.
    """
    name = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "none").otherwise(F.col(c)).alias(c)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name("source"), name("lang"), n_words(F.col("text")).alias("n_tokens"))
    rows = materialize(with_topics(narrow, embeddings), "mixed")
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("mass"))
    calibrated = materialize(calibrate(rake(cells, powers, rounds), budget).select(*MARGINS, "weight", "chance"), "chances")
    out = rows.join(calibrated, list(MARGINS), "left").withColumns({
        "weight": F.coalesce("weight", F.lit(1.0)), "chance": F.coalesce("chance", F.lit(float(budget)))})
    return out.select("doc_id", *MARGINS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("chance", 6).alias("chance"),
                      (uniform("doc_id") < F.round("chance", 6)).alias("keep"))


def sample(docs: DataFrame, embeddings: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """The documents that ``mix`` keeps, with all their columns; rows of one id are kept or left together."""
    chosen = mix(docs, embeddings, powers, budget, rounds).where("keep").select("doc_id").distinct()
    return docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["doc_id"]), "left_semi")


def mix_sql(powers: dict[str, float] = POWERS, budget: float = BUDGET, rounds: int = ROUNDS, steps: int = STEPS) -> str:
    """The same as one DuckDB statement over ``documents`` and ``embeddings``, the rounds written out.

    Equal to ``mix`` where ``rounds`` rounds bring all margins within the tolerance.
    """
    text = r"""WITH topics AS (SELECT vec_id AS doc_id, CAST(min(label) AS VARCHAR) AS topic FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id),
rows_ AS (SELECT d.doc_id, CASE WHEN coalesce(source, '') = '' THEN 'none' ELSE source END AS source,
  CASE WHEN coalesce(lang, '') = '' THEN 'none' ELSE lang END AS lang, coalesce(topic, 'none') AS topic,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM documents d LEFT JOIN topics USING (doc_id)),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM rows_ GROUP BY ALL HAVING sum(n_tokens) > 0),
c0 AS (SELECT *, mass / (SELECT sum(mass) FROM cells) AS fit FROM cells),
"""
    for column, power in powers.items():
        text += f"""p_{column} AS (SELECT {column}, pow(sum(fit), {power}) AS p FROM c0 GROUP BY {column}),
t_{column} AS (SELECT {column}, p / (SELECT sum(p) FROM p_{column}) AS want FROM p_{column}),
"""
    last = "c0"
    for turn in range(rounds):
        for column in powers:
            then = f"c{turn}_{column}"
            text += f"""{then} AS (SELECT c.source, c.lang, c.topic, c.mass, c.fit * (t.want / sum(c.fit) OVER (PARTITION BY c.{column})) AS fit
  FROM {last} c JOIN t_{column} t USING ({column})),
"""
            last = then
    text += f"""raked AS MATERIALIZED (SELECT * FROM {last}),
whole AS (SELECT sum(mass) AS total, max(fit / mass) * sum(mass) AS most FROM raked),
w AS MATERIALIZED (SELECT r.*, fit * total / mass AS weight FROM raked r, whole),
b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS low, {max(1.0, budget)} * 1e6 / greatest(most, 1e-12) AS high, total FROM whole),
"""
    for turn in range(4):
        point = f"high * pow(1e-12, 1 - i / {float(steps)})" if turn == 0 else f"low + (high - low) * i / {float(steps)}"
        text += f"""g{turn} AS MATERIALIZED (SELECT i, {point} AS c, low, high, total FROM b{turn}, range(1, {steps + 1}) t(i)),
s{turn} AS MATERIALIZED (SELECT i, c, any_value(low) AS low, any_value(total) AS total, sum(least(1.0, weight * c) * mass) AS s FROM g{turn}, w GROUP BY i, c),
o{turn} AS (SELECT coalesce(min(i) FILTER (WHERE s >= {budget} * total), {steps}) AS k FROM s{turn}),
b{turn + 1} AS MATERIALIZED (SELECT coalesce((SELECT c FROM s{turn}, o{turn} WHERE i = k - 1), any_value(low)) AS low,
  (SELECT c FROM s{turn}, o{turn} WHERE i = k) AS high, any_value(total) AS total FROM s{turn}),
"""
    return text + f"""final AS (SELECT source, lang, topic, weight, least(1.0, weight * high) AS chance FROM w, b4)
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(weight, 1.0), 6) AS weight, round(coalesce(chance, {budget}), 6) AS chance,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < round(coalesce(chance, {budget}), 6) AS keep
FROM rows_ LEFT JOIN final USING (source, lang, topic)"""
