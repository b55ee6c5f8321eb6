"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (one value of each dimension); cell weights are
raked to the target marginals of each dimension in turn, until all are met;
documents are then sampled with the probabilities that give these weights in
expectation. Targets are shares that the caller states, or the corpus's own
shares tempered by an exponent. Only DataFrame functions are used, and only the
table of cells goes through the loop.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import settle, tidy

#: Passes over all dimensions at most; after every few the fit is written, and ends when every marginal is off by at most CONVERGED of it.
ROUNDS, ROUNDS_AT_ONCE, CONVERGED = 12, 4, 1e-10
#: Up to so many cells are raked in one task, and sent to the scan of the documents by broadcast; more are raked by shuffles and joined.
SMALL_CELLS = 200_000
#: What a dimension's marginal shall be: an exponent that tempers its own shares (1 keeps them, 0 makes them equal), or the share of each value.
Wish = float | Mapping[str, float]
#: Fixed exponents of the default mix.
TEMPER: Mapping[str, Wish] = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SEED = 20
#: A marginal share is met when it is off its target by at most this part of it.
TOLERANCE = 0.01

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by plain signs in the text, for corpora without a topic column: the first that holds."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains("License") | t.contains("Copyright"), "legal").when(t.contains(" | "), "tabular").when(t.contains("@"), "contact").when(F.length(t) < 300, "short").otherwise("prose")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def _target(cells: DataFrame, dim: str, wish: Wish, mass: str = "tokens") -> DataFrame:
    """(dim, ``m``, ``share``) for every value with mass: its mass and the share that it shall have. The shares add up to 1.

    Of stated shares, values that the corpus lacks are left out and the others
    scaled up; values that are not named shall have none.
    """
    own = cells.groupBy(dim).agg(F.sum(mass).alias("m")).where("m > 0")
    if isinstance(wish, Mapping):
        stated = cells.sparkSession.range(1).select(F.explode(F.map_from_arrays(F.lit([str(k) for k in wish]), F.lit([float(v) for v in wish.values()]))).alias("value", "s"))
        own = own.join(F.broadcast(stated), own[dim] == stated["value"], "left").select(dim, "m", F.coalesce("s", F.lit(0.0)).alias("s"))  # as long as the caller's own list
    else:
        own = own.select(dim, "m", F.pow("m", F.lit(float(wish))).alias("s"))
    total = own.agg(F.sum("s")).first()[0]
    if own.limit(1).count() and not total:
        raise ValueError(f"no value of {dim} that has tokens has a target share")
    return own.select(dim, "m", (F.col("s") / F.lit(float(total or 1.0))).alias("share"))


def _off(cells: DataFrame, dims: Iterable[str]) -> float:
    """By what part of its target a marginal is off at most."""
    parts = [cells.groupBy(F.col(d).alias("v")).agg(F.sum("weight").alias("w"), F.first(f"__t_{d}").alias("t")).where("t > 0") for d in dims]
    return reduce(DataFrame.unionByName, [p.select(F.abs(F.col("w") / F.col("t") - 1).alias("off")) for p in parts]).agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, targets: Mapping[str, Wish], mass: str = "tokens", rounds: int = ROUNDS, converged: float = CONVERGED) -> DataFrame:
    """The cells with ``weight``: their mass, fitted so that each dimension has its target marginal.

    targets: for each dimension an exponent, by which value v gets a share in
    proportion to (mass of v) ** exponent, or stated shares by value. The total
    mass stays. Cells without mass, and cells of values whose share is 0, have
    weight 0. Dimensions have no NULLs. The fit ends when all marginals are met
    to ``converged``, or after ``rounds`` passes; ``marginals`` reports what is left.
    """
    size, total = cells.agg(F.count("*"), F.coalesce(F.sum(mass), F.lit(0)).cast("double")).first()
    small = size <= SMALL_CELLS
    out = cells.withColumn("weight", F.col(mass).cast("double"))
    for dim, wish in targets.items():
        target = _target(cells, dim, wish, mass).select(dim, (F.col("share") * total).alias(f"__t_{dim}"))
        out = out.join(F.broadcast(target) if small else target, dim, "left").withColumn(f"__t_{dim}", F.coalesce(f"__t_{dim}", F.lit(0.0)))

    def written(df: DataFrame) -> DataFrame:
        df = settle(df, "raked")
        return df.coalesce(1) if small else df

    out = written(out)
    for i in range(rounds):
        for dim in targets:
            if small:
                out = out.withColumn("__now", F.sum("weight").over(Window.partitionBy(dim)))
            else:
                out = out.join(out.groupBy(dim).agg(F.sum("weight").alias("__now")), dim)
            out = out.withColumn("weight", F.when(F.col("__now") > 0, F.col("weight") * F.col(f"__t_{dim}") / F.col("__now")).otherwise(0.0)).drop("__now")
            out = out if small else written(out)
        if i % ROUNDS_AT_ONCE == ROUNDS_AT_ONCE - 1 and i + 1 < rounds:
            out = written(out) if small else out
            if _off(out, targets) <= converged:
                break
    return out.drop(*[f"__t_{d}" for d in targets])


def ratio_of_one(fitted: DataFrame, rate: float | None = None) -> float:
    """The fitted ratio (``weight``) from which on a cell's rows are certain to be chosen.

    Without a rate this is the largest ratio. With one it is the ratio at which the
    probabilities min(1, ratio / it) keep that share of all ``tokens`` in expectation:
    Newton's steps, each one aggregate over the cells, clip more cells until none is added.
    """
    cells = fitted.where("weight > 0")
    top = cells.agg(F.max("weight"), F.min("weight"), F.sum("tokens"), F.sum(F.col("weight") * F.col("tokens"))).first()
    if top[0] is None:
        return 1.0
    if rate is None:
        return top[0]
    if not 0 < rate <= 1:
        raise ValueError("rate must lie in (0, 1]")
    budget, unit, certain = rate * top[2], top[3] / (rate * top[2]), 0
    while True:
        over = F.col("weight") > F.lit(unit)
        n, taken, free = cells.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight") * F.col("tokens"))), F.lit(0.0))).first()
        if free <= 0 or budget <= taken:
            return unit if free > 0 else top[1]
        if n == certain:
            return unit
        unit, certain = min(unit, free / (budget - taken)), n


def _dimensions(temper: Mapping[str, Wish], text_col: str, dims: Mapping[str, Column] | None) -> dict[str, Column]:
    """The column of each dimension: the one given, else ``topic`` of the text, else the column of that name. NULL is a value of its own."""
    own = {d: topic(F.col(text_col)) if d == "topic" else F.col(d) for d in temper} | dict(dims or {})
    return {d: F.coalesce(own[d].cast("string"), F.lit("(none)")) for d in temper}


def _fitted(counted: DataFrame, temper: Mapping[str, Wish], rate: float | None) -> DataFrame:
    """The table of cells with ``weight`` and ``probability``, from rows with dimensions and ``n_tokens``."""
    cells = settle(counted.groupBy(*temper).agg(F.sum("n_tokens").alias("tokens")), "cells")
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    fitted = settle(rake(cells, temper).select(*temper, "tokens", ratio.alias("weight")), "fitted")
    one = F.lit(ratio_of_one(fitted, rate))
    return fitted.withColumn("probability", F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("weight") / one)).otherwise(0.0))


def _chosen(rows: DataFrame, fitted: DataFrame, temper: Mapping[str, Wish], seed: int) -> DataFrame:
    fitted = fitted.drop("tokens")
    joined = rows.join(F.broadcast(fitted) if fitted.count() <= SMALL_CELLS else fitted, list(temper))
    return joined.withColumn("chosen", uniform(F.col("__id"), seed) < F.col("probability"))


def calibrated(docs: DataFrame, temper: Mapping[str, Wish] = TEMPER, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: float | None = None, dims: Mapping[str, Column] | None = None) -> DataFrame:
    """Every row as the struct ``row``, with its dimensions, ``n_tokens``, ``weight``, ``probability`` and ``chosen``.

    temper: for each dimension an exponent for its own shares, or the target share of
    each value. dims: columns for dimensions that are not columns by that name.
    ``weight`` is the fitted over the present token mass of the row's cell.
    Without ``rate`` probabilities are in proportion to it, with 1 for the
    largest, so that the expected mix has the target marginals and the sample is
    the largest that has: one small cell with a large weight makes the sample
    small. With ``rate`` the sample has that share of all tokens in expectation;
    cells that would need more than they have are taken whole, and ``marginals``
    tells which targets this leaves unmet. A row is chosen when a hash of its id
    and the seed lies below its probability: the same rows on every run, and
    repeated rows together. NULL dimensions are a value of their own ('(none)'),
    NULL texts have no tokens; rows of cells without tokens have weight and
    probability 0. Whole texts are counted, however long; an empty table gives no
    rows.
    """
    columns = [c.alias(d) for d, c in _dimensions(temper, text_col, dims).items()]
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("__id"), words(F.col(text_col)).alias("n_tokens"), *columns)
    return _chosen(rows, _fitted(rows.select("n_tokens", *temper), temper, rate), temper, seed)


def marginals(docs: DataFrame, temper: Mapping[str, Wish] = TEMPER, id_col: str = "doc_id", text_col: str = "text", rate: float | None = None, dims: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per dimension and value: ``target`` and ``expected`` share of the sample's tokens, and whether it is ``met`` (within TOLERANCE)."""
    columns = [c.alias(d) for d, c in _dimensions(temper, text_col, dims).items()]
    fitted = settle(_fitted(docs.select(words(F.col(text_col)).alias("n_tokens"), *columns), temper, rate), "fitted")
    total = fitted.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 1.0
    out = []
    for dim, wish in temper.items():
        expected = fitted.groupBy(dim).agg((F.sum(F.col("tokens") * F.col("probability")) / F.lit(float(total))).alias("expected"))
        out.append(_target(fitted, dim, wish).join(expected, dim).select(F.lit(dim).alias("dimension"), F.col(dim).alias("value"), F.col("share").alias("target"), "expected"))
    return reduce(DataFrame.unionByName, out).withColumn("met", F.abs(F.col("expected") - F.col("target")) <= F.col("target") * TOLERANCE)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The chosen rows of ``docs``, with their columns as they were (see ``calibrated``); repeated rows stay or go together."""
    return calibrated(docs, **how).where("chosen").select("row.*")


@tidy("mix")
def sample_report(docs: DataFrame) -> DataFrame:
    """One row per document: id, dimensions, tokens, weight and probability (6 decimals), and whether it is chosen."""
    columns = [c.alias(d) for d, c in _dimensions(TEMPER, "text", None).items()]
    rows = settle(docs.select(F.col("doc_id").alias("__id"), words(F.col("text")).alias("n_tokens"), *columns), "counted")  # texts are read once
    out = _chosen(rows, _fitted(rows, TEMPER, None), TEMPER, SEED)
    return out.select(F.col("__id").alias("doc_id"), *TEMPER, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), F.col("chosen").alias("kept"))


def sample_report_sql() -> str:
    """The same rows in DuckDB SQL; every pass of the fit is a step of its own."""
    dims = ", ".join(TEMPER)
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN contains(t, 'License') OR contains(t, 'Copyright') THEN 'legal' WHEN contains(t, ' | ') THEN 'tabular' WHEN contains(t, '@') THEN 'contact' WHEN length(t) < 300 THEN 'short' ELSE 'prose' END AS topic,
  len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0 AS u
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents))""",
        f"cells AS (SELECT {dims}, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL)",
    ]
    for dim, exponent in TEMPER.items():
        steps.append(f"m_{dim} AS (SELECT {dim}, sum(tokens)::DOUBLE AS m FROM cells GROUP BY {dim})")
        steps.append(f"t_{dim} AS (SELECT {dim}, CASE WHEN m > 0 THEN pow(m, {exponent}) ELSE 0 END / (SELECT sum(pow(m, {exponent})) FROM m_{dim} WHERE m > 0) * (SELECT sum(m) FROM m_{dim}) AS t FROM m_{dim})")
    steps.append(f"w0 AS MATERIALIZED (SELECT {dims}, tokens, tokens::DOUBLE AS weight FROM cells)")
    k = 0
    for _ in range(ROUNDS):
        for dim in TEMPER:
            others = ", ".join(f"c.{x}" for x in TEMPER)
            steps.append(
                f"w{k + 1} AS MATERIALIZED (SELECT {others}, c.tokens, CASE WHEN n.now > 0 THEN c.weight * t.t / n.now ELSE 0 END AS weight FROM w{k} c JOIN (SELECT {dim}, sum(weight) AS now FROM w{k} GROUP BY {dim}) n ON c.{dim} = n.{dim} JOIN t_{dim} t ON c.{dim} = t.{dim})"
            )
            k += 1
    steps.append(f"r AS (SELECT {dims}, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS weight FROM w{k})")
    steps.append(f"p AS (SELECT {dims}, weight, CASE WHEN weight > 0 THEN weight / (SELECT max(weight) FROM r) ELSE 0 END AS probability FROM r)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT d.doc_id, {', '.join('d.' + x for x in TEMPER)}, d.n_tokens, round(p.weight, 6) AS weight, round(p.probability, 6) AS probability, d.u < p.probability AS kept FROM d JOIN p USING ({dims})"
