"""Experiment conditions as tables: one pass gives every row to all conditions that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ordering import few, first_places, ranks, ranks_within
from quern.operators.rows import hashed
from quern.operators.sampling import shuffled_pairs, validation_split
from quern.scratch import materialize

#: Rows of the random pool and of the structured pool in each condition; ALL takes a whole pool.
ALL = 2**62
PRIMARY = (
    ("RANDOM-10K", ALL, 0),
    ("RANDOM-6K_STRUCTURED-4K", 6000, ALL),
    ("RANDOM-10K_STRUCTURED-4K", ALL, ALL),
    ("STRUCTURED-4K-ONLY", 0, ALL),
    ("RANDOM-4K", 4000, 0),
    ("STRUCTURED-2K", 0, 2000),
)


def scaling() -> list[tuple[str, int, int]]:
    """The scaling curves: either pool alone, structured rows added to 6000 random ones, and in place of as many of 10000."""
    return [
        *[(f"STRUCTURED-{n}", 0, n) for n in (200, 500, 1000, 2000, 3000, 4000)],
        *[(f"RANDOM-{n}", n, 0) for n in (200, 500, 1000, 2000, 4000, 6000, 8000, 10000)],
        *[(f"RANDOM-6K_STRUCTURED-{n}", 6000, n) for n in (500, 1000, 2000, 4000)],
        *[(f"REPLACE-R{10000 - n}_S{n}", 10000 - n, n) for n in (500, 1000, 2000, 4000)],
    ]


def families() -> list[tuple[str, str, int, int]]:
    return [("exp1", *c) for c in PRIMARY] + [("exp2", *c) for c in scaling()]


def _spec(conditions: list[tuple[str, str, int, int]]) -> Column:
    row = lambda c: F.struct(F.lit(c[0]).alias("experiment"), F.lit(c[1]).alias("condition"), F.lit(c[2]).cast("long").alias("r"), F.lit(c[3]).cast("long").alias("s"))
    return F.array(*[row(c) for c in conditions])


def assign(random: DataFrame, structured: DataFrame, key: str, module: str, conditions: list[tuple[str, str, int, int]] | None = None, validation: float = 0.1, seed: int = 1) -> DataFrame:
    """(experiment, condition, pool, key, split) of both pools. A random row is in the conditions whose size its rank reaches; a structured one where its rank within its module is within the module's share."""
    conditions = families() if conditions is None else conditions
    spec, most = _spec(conditions), [max((c[k] for c in conditions if c[k] != ALL), default=0) for k in (2, 3)]
    of_all = lambda k: _spec([c for c in conditions if c[k] == ALL]) if any(c[k] == ALL for c in conditions) else F.slice(spec, 1, 0)
    # most rows are beyond all sizes and in whole pools alone; no test of each condition is made for them
    held_by = lambda k, test: F.explode(F.when(F.col("_rank").isNull(), of_all(k)).otherwise(F.filter(spec, test))).alias("c")
    r = first_places(random.select(key).withColumn("_h", hashed(seed, F.col(key))), [], "_h", [key], most[0], "_rank")
    of_random = r.select(key, F.lit("random").alias("pool"), held_by(2, lambda c: F.col("_rank") <= c["r"]))
    s = first_places(structured.select(key, module).withColumn("_h", hashed(seed, F.col(key))), [module], "_h", [key], max(1, most[1]), "_rank")
    names = materialize(ranks(structured.select(F.col(module).alias("_m")).distinct(), ["_m"], "_o"), "modules")
    s = s.join(few(names), F.col(module).eqNullSafe(F.col("_m"))).withColumn("_strata", F.lit(names.count()))
    share = lambda c: F.greatest(F.lit(1).cast("long"), F.floor(c["s"] / F.col("_strata")))
    held = lambda c: (c["s"] == ALL) | ((F.col("_rank") <= share(c)) & (F.col("_o") <= c["s"]))
    of_structured = s.select(key, F.lit("structured").alias("pool"), held_by(3, held))
    rows = of_random.unionByName(of_structured).select("c.experiment", "c.condition", "pool", key)
    return validation_split(rows, ["experiment", "condition"], F.concat_ws("|", "pool", F.col(key).cast("string")), validation, seed)


def by_predicates(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """df once for each condition whose test holds, named in `condition`."""
    held = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in conditions.items()]))
    return df.withColumn("condition", F.explode(held))


def ablations(structured: DataFrame, module: str, pronoun: str, verb: str, verbs: list[str]) -> DataFrame:
    """Leave-one-module-out, singular and plural pronouns, one and two halves of the verbs: each a condition over the same rows."""
    half = max(1, len(verbs) // 2)
    tests = {"FULL": F.lit(True)} | {f"NO-M{k}": F.col(module) != k for k in range(1, 6)}
    tests |= {"PRONOUN-SINGULAR": F.col(pronoun).isin("je", "tu", "il", "elle"), "PRONOUN-PLURAL": F.col(pronoun).isin("nous", "vous", "ils", "elles")}
    tests |= {"VERB-FIRST-HALF": F.col(verb).isin(*verbs[:half]), "VERB-SECOND-HALF": F.col(verb).isin(*verbs[half:])}
    return by_predicates(structured, tests)


def job_grid(spark: SparkSession, conditions: list[str], seeds: list[int], models: list[str]) -> DataFrame:
    """(job, condition, seed, model) in order of condition, seed and model; a list of jobs, not of rows."""
    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    g = spark.range(1).select(F.posexplode(strings(conditions)).alias("c", "condition")).select("*", F.posexplode(strings(seeds)).alias("s", "seed")).select("*", F.posexplode(strings(models)).alias("m", "model"))
    return g.select((F.col("c") * len(seeds) * len(models) + F.col("s") * len(models) + F.col("m") + 1).alias("job"), "condition", "seed", "model")


#: Modules of the leave-one-out conditions, modules and rows a module of those of 1000 rows, pronouns of the coverage conditions.
WITHOUT_MODULES = {"FULL": (1, 2, 3, 4, 5), "NO-NEGATION": (1, 3, 4, 5), "NO-PAST": (1, 2, 4, 5), "NO-FUTURE": (1, 2, 3, 5), "NO-QUESTIONS": (1, 2, 3, 4), "BASE-ONLY": (1,)}
OF_1000_ROWS = {
    "FULL-1K": ((1, 2, 3, 4, 5), 200), "NO-NEG-1K": ((1, 3, 4, 5), 250), "NO-PAST-1K": ((1, 2, 4, 5), 250), "NO-FUT-1K": ((1, 2, 3, 5), 250), "NO-QUEST-1K": ((1, 2, 3, 4), 250), "BASE-1K": ((1,), 1000),
}
PRONOUN_SETS = {"ALL-8": ("je", "tu", "il", "elle", "nous", "vous", "ils", "elles"), "REDUCED-4": ("je", "tu", "il", "nous"), "SINGULAR-3": ("je", "tu", "il"), "MINIMAL-1": ("je",)}


def ablation_families(structured: DataFrame, key: str, module: str, pronoun: str, src: str, tgt: str, seed: int = 1) -> DataFrame:
    """structured (key, module from 1 to 5, pronoun, src, tgt) once for each condition that holds a row, with `family` and `condition`: modules left out, the same in 1000 rows at most, pronouns, and pairs intact and broken.

    Rows of a size-controlled condition are the first of each module by hashed key. Broken pairs have their targets permuted within each module but the first. Null modules and pronouns are in no condition of theirs.
    """
    tests = {f"module_loo/{n}": F.col(module).isin(*ms) for n, ms in WITHOUT_MODULES.items()}
    tests |= {f"module_size_ctrl/{n}": F.col(module).isin(*ms) & (F.col("_rank") <= most) for n, (ms, most) in OF_1000_ROWS.items()}
    tests |= {f"pronoun/{n}": F.col(pronoun).isin(*ps) for n, ps in PRONOUN_SETS.items()} | {"minimal_pairs/PAIRS-INTACT": F.lit(True)}
    ranked = ranks_within(structured.withColumn("_h", hashed(seed, F.col(key))), [module], ["_h", key], "_rank").drop("_h")
    broken = shuffled_pairs(structured, module, F.col(module) == 1, key, src, tgt, seed).withColumn("condition", F.lit("minimal_pairs/PAIRS-BROKEN"))
    rows = by_predicates(ranked, tests).drop("_rank").unionByName(broken)
    return rows.withColumn("family", F.substring_index("condition", "/", 1)).withColumn("condition", F.substring_index("condition", "/", -1))


def additive(structured: DataFrame, module: Column) -> DataFrame:
    """Curricula that add a module at a time, from the first two on."""
    return by_predicates(structured, {"ADD-" + "".join(f"M{k}" for k in range(1, last + 1)): module <= last for last in (2, 3, 4)})


def combos(structured: DataFrame, selections: dict[str, DataFrame], key: str) -> DataFrame:
    """(condition, key, ...): the structured rows with each selection, and with all of them, each key once; of equal keys the structured row stays, then that of the first selection."""
    from functools import reduce

    tag = lambda df, k, name: df.withColumn("_k", F.lit(k)).withColumn("condition", F.explode(F.array(*[F.lit(x) for x in name])))
    each = {n: f"STRUCT4K-{n}2K" for n in selections}
    parts = [tag(structured, 0, [*each.values(), "STRUCT4K-ALL-BASELINES"]), *[tag(df, k + 1, [each[n], "STRUCT4K-ALL-BASELINES"]) for k, (n, df) in enumerate(selections.items())]]
    whole = reduce(DataFrame.unionByName, parts)
    others = [c for c in whole.columns if c not in ("condition", key, "_k")]
    return whole.groupBy("condition", key).agg(F.min_by(F.struct("_k", *others), "_k").alias("_r")).select("condition", key, "_r.*").drop("_k")


def expansions(base: DataFrame, new: DataFrame, test: DataFrame, key: str, test_share: float = 0.1, seed: int = 1) -> DataFrame:
    """(run, split, key) of four ways to bring in new rows: A trains on the base; B1 adds the new rows to training only; B2 also holds out a share of them; B3 trains on the new rows alone.

    Keys of the fixed test set never train, in any run; new rows are never in B1's test. A key that the base has isn't new.
    """
    held = test.select(key).distinct()
    old = base.select(key).distinct().join(held, key, "left_anti").withColumn("origin", F.lit("base"))
    fresh = new.select(key).distinct().join(held, key, "left_anti").join(base.select(key).distinct(), key, "left_anti").withColumn("origin", F.lit("new"))
    ranked = ranks(fresh.withColumn("_h", hashed(seed, F.col(key))), ["_h", key], "_rank")
    n = fresh.agg(F.floor(F.count("*") * F.lit(test_share)).alias("_take"))
    fresh = ranked.join(F.broadcast(n)).select(key, "origin", (F.col("_rank") <= F.col("_take")).alias("_out"))
    rows = old.withColumn("_out", F.lit(False)).unionByName(fresh).unionByName(held.withColumn("origin", F.lit("test")).withColumn("_out", F.lit(False)))
    origin, out = F.col("origin"), F.col("_out")
    split = {
        "A": F.when(origin == "base", "train").when(origin == "test", "test"), "B1": F.when(origin == "test", "test").otherwise("train"),
        "B2": F.when((origin == "test") | out, "test").otherwise("train"), "B3": F.when(origin == "test", "test").when(origin == "new", "train"),
    }
    runs = F.explode(F.array(*[F.struct(F.lit(name).alias("run"), s.alias("split")) for name, s in split.items()]))
    return rows.select(key, "origin", runs.alias("r")).select("r.run", "r.split", "origin", key).filter("split IS NOT NULL")


def combined(parts: list[DataFrame], text: str, order: str, keys: list[str], date: str, error: str = "ERROR") -> DataFrame:
    """Generated modules in one table: rows that failed go, of equal keys the first in order stays, `created` is the date given."""
    from functools import reduce

    from quern.operators.rows import keep_first

    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).filter(F.coalesce(F.col(text), F.lit(error)) != error)
    return keep_first(whole, keys, [order]).withColumn("created", F.lit(date))
