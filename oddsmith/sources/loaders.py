"""Loaders. What they return is lazy, but for the rows, problems and market baseline of CsvChallenge, which are written as tables; JSON is parsed by Spark."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalized, smoothed
from ..operators.select import min_counts, with_time_rank
from ..plans.lineage import cut
from .json_repair import tolerant_json

ASKS = "map<string, struct<yes_ask: double, no_ask: double>>"
INFO = "map<string, struct<title: string, open_time: string, close_time: string, liquidity: double, yes_ask: double, no_ask: double, yes_bid: double, no_bid: double>>"
STATED = "struct<probabilities: array<struct<market: string, probability: double>>>"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')


_STRING = r"""\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'"""


def lenient_json(col: Column, schema: str) -> Column:
    """JSON, or a Python literal of dicts, lists, strings and numbers; a comma before a closing
    bracket is allowed in both. Names and commas inside of strings are left as they are. Texts that are damaged beyond that are repaired."""
    plain = F.regexp_replace(col, rf"(?s)({_STRING})|,(?=\s*[\]}}])", "$1")
    # Strings are matched first, so that what is in them is no name.
    parts = F.regexp_extract_all(plain, F.lit(rf"(?s){_STRING}|\b(?:None|True|False)\b|[^\"'NTF]++|."), F.lit(0))
    said = F.array_join(F.transform(parts, lambda x: F.when(x == "None", "null").when(x == "True", "true").when(x == "False", "false").otherwise(x)), "")
    return tolerant_json(col, schema, said)


def _sorted_keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def asks(m: Column, side: str) -> Column:
    return F.transform(_sorted_keys(m), lambda k: m[k][side] / 100)


def stated(p: Column) -> Column:
    """Probabilities by market name; of repeated names the last counts."""
    keys = F.array_sort(F.array_distinct(F.transform(p, lambda x: x["market"])))
    return F.transform(keys, lambda k: F.try_element_at(F.filter(p, lambda x: x["market"] == k), F.lit(-1))["probability"])


def _read(x: DataFrame, **schemas: str) -> DataFrame:
    """x with each named column of texts read as lenient_json reads it, once a row. A text that its schema fits goes no
    further; the others alone are kept for lenient_json."""
    fits = {k: F.col(f"_{k}.probabilities").isNotNull() if s == STATED else F.size(F.array_distinct(F.map_keys(f"_{k}"))) == F.size(f"_{k}") for k, s in schemas.items()}
    x = x.withColumns({f"_{k}": F.from_json(k, s, {"allowSingleQuotes": "true"}) for k, s in schemas.items()})
    x = x.withColumns({k: F.when(~F.coalesce(fit, F.lit(False)), F.col(k)) for k, fit in fits.items()})
    return x.withColumns({k: F.when(F.col(k).isNull(), F.col(f"_{k}")).otherwise(lenient_json(F.col(k), s)) for k, s in schemas.items()}).drop(*(f"_{k}" for k in schemas))


def _once(x: DataFrame, *kept: str, **parts: Column) -> DataFrame:
    """The columns `kept`, and `parts`, worked out once a row: Spark moves no later filter or join condition before a generator, where it
    would read the JSON anew for each use, and within lambdas for each element."""
    return x.select(*kept, F.inline(F.array(F.struct(*(c.alias(k) for k, c in parts.items())))))


def nightly(spark: SparkSession, predictions: str, submissions: str, weight_fn=None, exclude=()) -> DataFrame:
    """The canonical wide frame from a predictions and a submissions CSV."""
    p = _csv(spark, predictions).select(F.col("predictor_name").alias("forecaster"), "event_ticker", F.col("submission_count").cast("int").alias("round"), "category", F.col("prediction").alias("s"), F.col("market_outcome").alias("o"))
    p = _read(p.where(~F.col("forecaster").isin(*exclude)) if exclude else p, s=STATED, o="map<string, double>")
    p = _once(p, "forecaster", "event_ticker", "round", "category", prediction=stated(F.col("s.probabilities")), outcome=F.transform(_sorted_keys(F.col("o")), lambda k: F.col("o")[k]))
    s = _csv(spark, submissions).select("event_ticker", F.col("submission_count").cast("int").alias("round"), F.col("market_data").alias("m"), *(F.col(c).try_cast("timestamp").alias(c) for c in ("snapshot_time", "close_time")))
    s = _once(_read(s, m=ASKS), "event_ticker", "round", "snapshot_time", "close_time", odds=asks(F.col("m"), "yes_ask"), no_odds=asks(F.col("m"), "no_ask"))
    x = p.join(s.hint("merge"), ["event_ticker", "round"]).select("forecaster", "event_ticker", "round", "category", "prediction", "outcome", "odds", "no_odds", "snapshot_time", "close_time")
    x = with_time_rank(x.where("size(odds) = size(prediction) and size(odds) = size(outcome)")).withColumn("weight", F.lit(1.0))
    return x.transform(weight_fn) if weight_fn else x


class ChallengeLoader(ABC):
    """What a connector gives: problems and forecasts, and facts about them."""

    @abstractmethod
    def load(self) -> tuple[DataFrame, DataFrame]: ...

    title: str | None = None
    files: dict = {}

    def metadata(self) -> dict:
        """Title, numbers of problems and forecasters, and the files that were read, without building the challenge where that can be helped."""
        problems, forecasts = self.load()
        return {"title": self.title, "problems": problems.count(), "forecasters": forecasts.select("username").distinct().count(), **self.files}


class JsonChallenge(ChallengeLoader):
    """Arrays of predictions and of problem metadata, as files or frames."""

    def __init__(self, predictions: DataFrame, problems: DataFrame, per_problem: int = 0, per_user: int = 0):
        self.predictions, self.problems, self.per_problem, self.per_user = predictions, problems, per_problem, per_user

    @classmethod
    def from_files(cls, spark: SparkSession, predictions: str, problems: str, **options) -> JsonChallenge:
        """The title is the first part of the problems' file name, up to an underscore."""
        out = cls(spark.read.json(predictions, multiLine=True), spark.read.json(problems, multiLine=True), **options)
        out.title = problems.rstrip("/").rsplit("/", 1)[-1].split(".")[0].split("_")[0]
        out.files = {"predictions_file": predictions, "metadata_file": problems}
        return out

    def metadata(self) -> dict:
        """Problems are counted as the metadata lists them."""
        return {"title": self.title, "problems": self.problems.count(), "forecasters": self.predictions.select("username").distinct().count(), **self.files}

    def load(self):
        meta = F.col("metadata")
        fields = self.problems.schema["metadata"].dataType.names
        end = F.coalesce(*(meta[c] for c in ("end_date", "end_time") if c in fields)).try_cast("timestamp")
        position = F.array_position("options", F.col("correct_answer"))
        problems = self.problems.select("problem_id", "title", "options", F.when(position > 0, F.array((position - 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("correct_option_idx"), F.size("options").alias("n_options"), end.alias("end_time"), F.lit(None).cast("string").alias("category"))
        f = self.predictions.join(problems.select("problem_id"), "problem_id", "left_semi")
        f = f.select("problem_id", "username", F.col("timestamp").try_cast("timestamp").alias("timestamp"), F.col("prediction").alias("unnormalized_probs"), normalized("prediction").alias("probs"))
        f = f.withColumn("forecast_seq", F.unix_micros("timestamp")).withColumn("forecast_id", F.concat_ws("-", "problem_id", "username", "timestamp")).withColumn("weight", F.lit(1.0))
        return problems, min_counts(f, self.per_problem, self.per_user) if self.per_problem or self.per_user else f


def implied(m: Column, keys: Column, use_bid: bool = False, side: str = "yes") -> Column:
    """Prices as probabilities; illiquid or unpriced markets count as 1. Not normalized."""

    def one(k):
        x = m[k]
        ask, bid = F.coalesce(x[f"{side}_ask"], F.lit(100.0)), F.coalesce(x[f"{side}_bid"], F.lit(0.0))
        price = (bid + ask) / 2 if use_bid else ask
        return F.when((F.coalesce(x["liquidity"], F.lit(0.0)) < 100) | (ask <= 0), 100.0).otherwise(price) / 100

    return F.transform(keys, one)


class CsvChallenge(ChallengeLoader):
    """One CSV with a row for each forecast and its market state."""

    def __init__(self, rows: DataFrame, use_bid: bool = False, use_open_time: bool = False, market_baseline: bool = False):
        self.rows, self.use_bid, self.use_open_time, self.market_baseline = rows, use_bid, use_open_time, market_baseline

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, **options) -> CsvChallenge:
        out = cls(_csv(spark, path), **options)
        out.files = {"predictions_file": path}
        return out

    def metadata(self) -> dict:
        """From the rows alone: problems are submissions where the file names them, else events."""
        key = "submission_id" if "submission_id" in self.rows.columns else "event_ticker"
        r = self.rows.agg(F.countDistinct(key), F.countDistinct("predictor_name")).first()
        return {"title": self.title or "Arena challenge", "problems": r[0], "forecasters": r[1], **(self.files or {"predictions_file": None})}

    def load(self):
        x = self.rows.withColumn("seq", F.monotonically_increasing_id())
        category = F.col("category") if "category" in x.columns else F.lit(None).cast("string").alias("category")
        x = _read(x.select("event_ticker", "seq", "predictor_name", category, F.col("market_info").alias("m"), F.col("market_outcome").alias("o"), F.col("prediction").alias("p")), m=INFO, o="map<string, double>", p=STATED)
        x = x.withColumns({"keys": _sorted_keys(F.col("m")), "p": F.col("p.probabilities")})
        said = lambda p, k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at(F.filter(p, lambda y: y["market"] == k), F.lit(-1))["probability"], F.lit(0.0))))
        won = F.filter(F.transform("keys", lambda k, i: F.when(F.col("o")[k] == 1, i)), lambda i: i.isNotNull())
        when = F.array_max(F.transform("keys", lambda k: F.col("m")[k]["open_time" if self.use_open_time else "close_time"].try_cast("timestamp")))
        named = lambda k: F.array_contains(F.coalesce("keys", F.array().cast("array<string>")), k)
        # Texts are read once, and rows keep their numbers. Vectors are of the row's own markets, and `rest` is of what it says of others.
        x = cut(
            x.select(
                "event_ticker", "seq", "predictor_name", "category", "keys", won.alias("won"), when.alias("end_time"), F.transform("keys", lambda k: said("p", k)).alias("u"), F.filter("p", lambda y: ~named(y["market"])).alias("rest"),
                implied(F.col("m"), F.col("keys"), self.use_bid).alias("odds"), implied(F.col("m"), F.col("keys"), self.use_bid, "no").alias("no_odds"),
            )
        )
        first = x.groupBy("event_ticker").agg(F.min_by(F.struct("keys", "won", "end_time", "category"), "seq").alias("f"), F.min("seq").alias("problem_seq"), F.min("keys").alias("low"), F.max("keys").alias("high"), F.count("keys").alias("k"), F.count("*").alias("n"))
        first = cut(first.select("event_ticker", "problem_seq", "f.*", ((F.col("k") == 0) | ((F.col("k") == F.col("n")) & (F.col("low") == F.col("high")))).alias("alike")))
        problems = first.select(F.col("event_ticker").alias("problem_id"), "problem_seq", F.col("event_ticker").alias("title"), F.col("keys").alias("options"), F.col("won").alias("correct_option_idx"), F.size("keys").alias("n_options"), "end_time", "category")
        f, others = x.where("event_ticker is not null"), first.where("not alike").select("event_ticker", F.struct("keys").alias("of"))
        if not others.isEmpty():  # only rows whose markets are not those of the first row of their event need its markets
            options, at = F.col("of.keys"), lambda k: F.array_position("keys", k)
            taken = lambda v, k, other: F.when(at(k) > 0, F.get(v, (at(k) - 1).cast("int"))).otherwise(other)
            moved = {"u": lambda k: taken("u", k, said("rest", k)), "odds": lambda k: taken("odds", k, F.lit(1.0)), "no_odds": lambda k: taken("no_odds", k, F.lit(1.0))}
            f = f.join(others, "event_ticker", "left").withColumns({c: F.when(F.col("of").isNull() | options.eqNullSafe(F.col("keys")), F.col(c)).otherwise(F.transform(options, body)) for c, body in moved.items()})
        f = f.select(
            F.concat_ws("-", "event_ticker", "seq").alias("forecast_id"), F.col("event_ticker").alias("problem_id"), F.col("seq").alias("forecast_seq"), F.col("predictor_name").alias("username"),
            F.col("u").alias("unnormalized_probs"), normalized("u").alias("probs"), F.lit(1.0).alias("weight"), smoothed("odds").alias("odds"), smoothed("no_odds").alias("no_odds"),
        )
        if self.market_baseline:
            m = f.select("problem_id", F.posexplode(F.arrays_zip("odds", "no_odds")).alias("k", "z")).groupBy("problem_id", "k").agg(F.avg("z.odds").alias("a"), F.avg("z.no_odds").alias("b"))
            m = cut(m.groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct("k", "a", "b"))).alias("z")))
            price = F.transform("z", lambda z: z["a"])
            m = m.select(F.concat_ws("-", "problem_id", F.lit("market")).alias("forecast_id"), "problem_id", F.lit(-1).cast("long").alias("forecast_seq"), F.lit("market-baseline").alias("username"), price.alias("unnormalized_probs"), normalized(price).alias("probs"), F.lit(1.0).alias("weight"), price.alias("odds"), F.transform("z", lambda z: z["b"]).alias("no_odds"))
            f = f.unionByName(m)
        return problems, f


def comments(pages: DataFrame) -> DataFrame:
    """(problem_id, username, timestamp, prediction) from comment pages (problem_id, html);
    of each (problem, user) the first. Percent texts become fractions, missing ones 0."""
    block = F.regexp_extract_all("html", F.lit(r'(?s)<div class="flyover-comment rationale">.*?(?=<div class="flyover-comment rationale">|\z)'), F.lit(0))
    x = pages.select("problem_id", F.posexplode(block).alias("k", "b"))
    share = F.transform(F.regexp_extract_all("b", F.lit(r'class="probability-value"[^>]*>\s*([^<]*?)\s*<'), F.lit(1)), lambda p: F.coalesce(F.regexp_replace(p, "%", "").try_cast("double") / 100, F.lit(0.0)))
    x = x.select("problem_id", "k", F.regexp_extract("b", r'class="membership-username"[^>]*>\s*([^<]*?)\s*<', 1).alias("username"), F.regexp_extract("b", r'data-localizable-timestamp="([^"]*)"', 1).try_cast("timestamp").alias("timestamp"), share.alias("prediction"))
    x = x.where("username <> ''").groupBy("problem_id", "username").agg(F.min(F.struct("k", "timestamp", "prediction")).alias("f"))
    return x.select("problem_id", "username", "f.timestamp", "f.prediction")


def _found(html, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), r"\s+", " "))


def question_list(pages: DataFrame) -> DataFrame:
    """(problem_id, title, url, status, end_time, num_forecasters, num_forecasts) from pages (html) that list questions."""
    head = r'<div[^>]*\bid="row-table-question-\d+"'
    block = F.regexp_extract_all("html", F.lit(rf"(?s){head}.*?(?={head}|\z)"), F.lit(0))
    x = pages.select(F.explode(block).alias("b"))
    count = lambda kind: _found(F.col("b"), rf'(?s)<a[^>]*\bdata-sort="{kind}"[^>]*>\D*?(\d+)').try_cast("int")
    return x.select(
        _found(F.col("b"), r'\bid="row-table-question-(\d+)"').alias("problem_id"),
        _plain(_found(F.col("b"), r"(?s)<h5[^>]*>.*?<a\b[^>]*>(.*?)</a>")).alias("title"),
        _found(F.col("b"), r'(?s)<h5[^>]*>.*?<a\b[^>]*\bhref="([^"]*)"').alias("url"),
        _plain(_found(F.col("b"), r'(?s)<span[^>]*\bclass="[^"]*\binfo-heading\b[^"]*"[^>]*>(.*?)</span>')).alias("status"),
        _found(F.col("b"), r'data-localizable-timestamp="([^"]*)"').alias("end_time"),
        count("predictors_count").alias("num_forecasters"),
        count("prediction_sets_count").alias("num_forecasts"),
    ).where("title is not null")


def question_options(pages: DataFrame) -> DataFrame:
    """(problem_id, options, correct_answer) from detail pages (problem_id, html): rows of
    three cells or more of the consensus table, the last marked one being correct."""
    body = _found(F.col("html"), r'(?s)<table[^>]*\bclass="[^"]*\bconsensus-table\b[^"]*"[^>]*>.*?<tbody[^>]*>(.*?)</tbody>')
    rows = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.filter(F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))), lambda c: F.size(c) >= 3)
    right = F.filter("c", lambda c: F.get(c, F.lit(1)).rlike(r'<i[^>]*class="[^"]*\bfa-check-circle\b'))
    x = pages.select("problem_id", cells.alias("c"))
    name = lambda c: _plain(F.get(c, F.lit(0)))
    return x.select("problem_id", F.transform("c", name).alias("options"), F.try_element_at(F.transform(right, name), F.lit(-1)).alias("correct_answer"))


def market_rows(rows: DataFrame, forecasters=()) -> DataFrame:
    """rows (predictor_name, prediction, market_outcome as JSON) with num_markets, dilution and
    brier: over the markets of the outcome, in which an unnamed prediction counts as 0 and all
    are held to [0, 1]. Rows whose JSON cannot be read go."""
    x = rows.where(F.col("predictor_name").isin(*forecasters)) if forecasters else rows
    x = x.withColumn("_o", lenient_json(F.col("market_outcome"), "map<string, double>")).withColumn("_p", lenient_json(F.col("prediction"), STATED)["probabilities"])
    said = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at(F.filter("_p", lambda y: y["market"] == k), F.lit(-1))["probability"], F.lit(0.0))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = F.size("_o")
    hits = F.transform(F.map_values("_o"), lambda v: F.when(v.cast("int") == 1, 1.0).otherwise(0.0))
    error = F.transform(F.map_keys("_o"), lambda k: (said(k) - F.col("_o")[k]) * (said(k) - F.col("_o")[k]))
    x = x.where("_o is not null and _p is not null and size(_o) > 0").withColumns({"num_markets": n, "dilution": total(hits) / n, "brier": total(error) / n})
    return x.drop("_o", "_p").dropna(subset=["num_markets", "dilution", "brier"])


def augmented(spark: SparkSession, path: str, forecasters=()) -> DataFrame:
    """market_rows of a CSV file."""
    return market_rows(_csv(spark, path), forecasters)
