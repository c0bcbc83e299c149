"""Epoch-wise training with validation and a stop (M1 with M7-M9).

A bag-of-words logistic model is fitted by mini-batch AdamW. The model is a
table, one row per word (weight and both moments), so its size is bounded by
the vocabulary and not by a machine. A step joins the words of one batch with
the weights, sums margins by text and gradients by word, and writes the next
state of the model; each epoch runs through all batches, is validated, and
writes one row of statistics. Training stops by the early-stop rule (M9) on the
validation loss or after ``epochs``.

Texts are cut into words once and kept as one row a text, with arrays of word
ids; ids go by falling frequency. The weights of the ``HOT`` most frequent words
are broadcast and meet the words where they are; only the rarer words are
shuffled to their weights. For the gradient the errors are joined with the
arrays, and words are summed in each task before they are shuffled.

The learning rate rises linearly over the first ``warmup`` share of all steps and
falls linearly to zero after it; gradients are clipped to norm ``clip``. A batch
is the set of texts whose id hash falls into one of ``batches`` parts, so it
grows with the corpus, and so does the work that a step shares out.

All that an epoch leaves is below ``path``: the model, then the statistics,
whose commit marks the epoch as done. A run that finds done epochs goes on
after the last of them; a half-written epoch is written again.

Defined results: rows without a label (0 or 1) take no part; a null text is an
empty one and has the constant's margin; a repeated id is a row of its own;
without training rows there is no epoch; without validation rows the validation
columns are null and nothing stops early."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_runs
from ..session import BROADCAST_KNOWN_ROWS, sized
from ..sources import files
from ..sources.csv_scan import append_run, read_runs
from .joins import join_known
from .metrics import _weighted_exprs, early_stop
from .ranking import rank_by_order

METRICS = ("loss", "accuracy", "f1", "recall", "precision")
#: Trials that are trained side by side.
AT_ONCE = 4
#: Words whose weights are broadcast: those with ids below this.
HOT = BROADCAST_KNOWN_ROWS


@dataclass(frozen=True)
class Settings:
    lr: float = 0.05
    epochs: int = 15
    batches: int = 4
    warmup: float = 0.1
    decay: float = 0.01
    clip: float = 1.0
    patience: int = 2
    delta: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    metric_rows: int = 16
    seed: int = 123


def rate(s: Settings, step: int) -> float:
    """Learning rate of the 0-based ``step``."""
    total = s.epochs * s.batches
    rise = int(total * s.warmup)
    return s.lr * (step / rise if step < rise else max(0.0, (total - step) / max(1, total - rise)))


def counts(rows: DataFrame, text: str) -> DataFrame:
    """``(row, norm, words)``: a text's words with their counts, and the norm of
    the counts; texts without a word are left out. The texts are dealt by row,
    so their words are not shuffled."""
    words = rows.select("row", F.coalesce(F.col(text), F.lit("")).alias("text")).repartition("row").select(
        "row", F.explode(word_runs("text")).alias("word"))
    n = words.groupBy("row", "word").agg(F.count("*").alias("n"))
    return n.groupBy("row").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.collect_list(F.struct("word", "n")).alias("words"))


def features(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(row, word, x)``: counts of a text's words scaled to norm 1, and the
    constant (the empty word)."""
    n = counts(rows, text).select("row", "norm", F.explode("words").alias("w"))
    x = n.select("row", "w.word", (F.col("w.n") / F.col("norm")).alias("x"))
    return x.unionByName(rows.select("row", F.lit("").alias("word"), F.lit(1.0).alias("x")))


class Texts:
    """The labelled texts of training and validation (``held``), cut into words
    once for any number of trainers. ``table``: ``(row, id, label, held, norm,
    hot, cold)``, where ``hot`` and ``cold`` are arrays of (id, n) with ids below
    ``HOT`` and the others; the constant has no n. ``vocab``: ``(word, id)``."""

    def __init__(self, train: DataFrame, val: DataFrame, id_col: str = "ID", text: str = "text", label: str = "label"):
        def labelled(df, held):
            return df.where(F.col(label).isin(0, 1)).select(
                F.col(id_col).cast("string").alias("id"), F.col(label).cast("int").alias("label"), F.col(text).alias("text"), F.lit(held).alias("held"))

        rows = sized(labelled(train, False).unionByName(labelled(val, True)).withColumn("row", F.monotonically_increasing_id()))
        counted = sized(counts(rows, "text"))
        pairs = counted.select("row", "norm", F.explode("words").alias("w")).select("row", "norm", "w.word", F.col("w.n").cast("int").alias("n"))
        words = sized(pairs.groupBy("word").agg(F.count("*").alias("rows")))
        ranked = rank_by_order(words, [F.col("rows").desc(), F.col("word")], "id")
        constant = words.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).alias("id"))
        self.vocab = sized(ranked.select("word", (F.col("id") + 1).cast("int").alias("id")).unionByName(constant))
        self.tail = self.vocab.count() > HOT  # are there words that are not broadcast?
        hot = F.when(F.col("id") < HOT, F.struct("id", "n"))
        cold = F.when(F.col("id") >= HOT, F.struct("id", "n"))
        rare = self.vocab.where(F.col("id") >= HOT) if self.tail else None
        known = join_known(pairs, self.vocab.where(F.col("id") < HOT), rare, "word")
        arrays = known.groupBy("row").agg(F.first("norm").alias("norm"), F.collect_list(hot).alias("hot"), F.collect_list(cold).alias("cold"))
        one = F.array(F.struct(F.lit(0).alias("id"), F.lit(None).cast("int").alias("n")))
        none = F.array().cast("array<struct<id:int,n:int>>")
        self.table = sized(rows.drop("text").join(arrays, "row", "left").select(
            "row", "id", "label", "held", "norm", F.concat(one, F.coalesce("hot", none)).alias("hot"), F.coalesce("cold", none).alias("cold")))


def entries(texts: DataFrame, words: str | Column, *columns: str) -> DataFrame:
    """``(row, id, x)`` and ``columns`` of the texts' ``words``; x is the count scaled
    to norm 1, and 1 for the constant."""
    x = texts.select("row", "norm", *columns, F.explode(words).alias("w"))
    return x.select("row", "w.id", F.coalesce(F.col("w.n") / F.col("norm"), F.lit(1.0)).alias("x"), *columns)


class Trainer:
    """Training rows and their state under ``path``. ``texts``: the rows as an
    earlier trainer has cut them, or None."""

    def __init__(self, train: DataFrame, val: DataFrame, path: str, settings: Settings = Settings(), id_col: str = "ID",
                 text: str = "text", label: str = "label", texts: Texts | None = None):
        self.spark: SparkSession = train.sparkSession
        self.path, self.s = path.rstrip("/"), settings
        s = settings
        self.data = texts or Texts(train, val, id_col, text, label)
        key = F.concat_ws(":", F.coalesce("id", F.lit("")), F.lit(s.seed))
        part = F.when(F.col("held"), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(s.batches)).cast("int"))
        rows = self.data.table.select("row", "id", "label", part.alias("part"))
        # consecutive rows of a part, in the order of their hash, are averaged together (M7)
        chunk = F.pmod(F.xxhash64(key, F.lit("m")), F.greatest(F.lit(1), F.ceil(F.col("size") / s.metric_rows)).cast("bigint"))
        sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
        self.rows = sized(rows.join(F.broadcast(sizes), "part").select("row", "part", "label", "size", chunk.alias("chunk")))  # one row a batch
        self.texts = sized(self.data.table.select("row", "norm", "hot", "cold", part.alias("part")), by="part")
        found = self.rows.groupBy(F.col("part") >= 0).count().collect()
        self.sizes = {bool(r[0]): r[1] for r in found}

    @property
    def x(self) -> DataFrame:
        """``(row, word, x)`` of all texts."""
        return entries(self.texts, F.concat("hot", "cold")).join(self.data.vocab, "id").select("row", "word", "x")

    # ------------------------------------------------------------- one pass
    def margins(self, model: DataFrame, part: int) -> DataFrame:
        """``(row, label, size, chunk, z)`` of one batch, -1 is validation.
        ``model`` has the words' ids."""
        mine, w = self.texts.where(F.col("part") == part), model.select("id", "w")
        total = F.sum(F.col("x") * F.col("w")).alias("z")
        z = entries(mine, "hot").join(F.broadcast(w.where(F.col("id") < HOT)), "id").groupBy("row").agg(total)
        if self.data.tail:
            cold = entries(mine, "cold").join(w.where(F.col("id") >= HOT), "id").groupBy("row").agg(total)
            z = z.unionByName(cold).groupBy("row").agg(F.sum("z").alias("z"))
        return self.rows.where(F.col("part") == part).join(z, "row", "left").withColumn("z", F.coalesce("z", F.lit(0.0)))

    def measured(self, scored: DataFrame) -> dict:
        """M7: the unweighted mean over small batches."""
        p = (F.col("z") > 0).cast("int")
        m = F.when(F.col("label") == 1, F.col("z")).otherwise(-F.col("z"))
        loss = F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
        x = scored.withColumn("pred", p).groupBy("part", "chunk").agg(
            F.avg(loss).alias("loss"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), *_weighted_exprs())
        r = x.agg(*[F.avg(c).alias(c) for c in METRICS]).first()
        return {c: r[c] for c in METRICS}

    def step(self, model: DataFrame, scored: DataFrame, part: int, number: int) -> DataFrame:
        """The model (with ids) after one AdamW step on one batch."""
        s = self.s
        error = scored.select("row", ((F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z"))) - F.col("label")) / F.col("size")).alias("e"))
        mine = self.texts.where(F.col("part") == part).join(error, "row")
        grad = sized(entries(mine, F.concat("hot", "cold"), "e").groupBy("id").agg(F.sum(F.col("x") * F.col("e")).alias("g")))
        norm = math.sqrt(grad.agg(F.sum(F.col("g") * F.col("g")).alias("s")).first()["s"] or 0.0)
        scale, lr, t = min(1.0, s.clip / (norm + 1e-6)), rate(s, number), number + 1
        g = F.coalesce("g", F.lit(0.0)) * scale
        m = F.lit(s.beta1) * F.col("m") + F.lit(1 - s.beta1) * g
        v = F.lit(s.beta2) * F.col("v") + F.lit(1 - s.beta2) * g * g
        move = (m / (1 - s.beta1 ** t)) / (F.sqrt(v / (1 - s.beta2 ** t)) + s.eps)
        fade = F.when(F.col("word") == "", F.lit(1.0)).otherwise(F.lit(1 - lr * s.decay))
        return model.join(grad, "id", "left").select("id", "word", (F.col("w") * fade - lr * move).alias("w"), m.alias("m"), v.alias("v"))

    # --------------------------------------------------------------- epochs
    def done(self) -> int:
        """Epochs whose statistics are committed, without a gap."""
        n = 0
        while files.exists(self.spark, f"{self.path}/stats/epoch={n + 1}/_SUCCESS"):
            n += 1
        return n

    def stats(self) -> DataFrame:
        cols = ", ".join(f"{side}_{c} double" for side in ("train", "val") for c in METRICS)
        n = self.done()
        empty = self.spark.createDataFrame([], f"epoch int, {cols}")
        return empty if not n else self.spark.read.schema(empty.schema).parquet(*[f"{self.path}/stats/epoch={i}" for i in range(1, n + 1)])

    def model(self, epoch: int) -> DataFrame:
        if epoch == 0:
            zero = F.lit(0.0)
            return self.data.vocab.select("word", zero.alias("w"), zero.alias("m"), zero.alias("v"))
        return self.spark.read.schema("word string, w double, m double, v double").parquet(f"{self.path}/model/epoch={epoch}")

    def stopped(self) -> bool:
        """M9 on the validation loss."""
        r = early_stop(self.stats().where("val_loss is not null").withColumn("g", F.lit(0)), ["g"], "epoch", "val_loss",
                       self.s.patience, self.s.delta, "min").first()
        return bool(r and r["stop_epoch"])

    def epoch(self, n: int) -> None:
        """Train, validate and record epoch ``n`` (from 1)."""
        model, seen = sized(self.model(n - 1).join(self.data.vocab, "word", "left")), None
        for part in range(self.s.batches):
            scored = sized(self.margins(model, part))
            seen = scored if seen is None else seen.unionByName(scored)
            model = sized(self.step(model, scored, part, (n - 1) * self.s.batches + part))
        model.drop("id").write.mode("overwrite").parquet(f"{self.path}/model/epoch={n}")
        row = {f"train_{c}": v for c, v in self.measured(seen).items()}
        row |= {f"val_{c}": v for c, v in self.measured(self.margins(model, -1)).items()}
        line = self.spark.range(1).select(F.lit(n).cast("int").alias("epoch"), *[F.lit(v).cast("double").alias(c) for c, v in row.items()])
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/epoch={n}")

    def run(self, most: int | None = None) -> DataFrame:
        """Train to the stop, or for ``most`` further epochs; the statistics."""
        if self.sizes.get(True):
            n = self.done()
            last = self.s.epochs if most is None else min(self.s.epochs, n + most)
            while n < last and not self.stopped():
                n += 1
                self.epoch(n)
        return self.stats()


def train(train_rows: DataFrame, val: DataFrame, path: str, settings: Settings = Settings(), **columns) -> DataFrame:
    """The statistics of a training run under ``path``: ``epoch`` and, for
    training and validation, loss, accuracy, F1, recall and precision."""
    return Trainer(train_rows, val, path, settings, **columns).run()


def predict(model: DataFrame, texts: DataFrame, id_col: str = "ID", text: str = "text") -> DataFrame:
    """``texts`` rows' ``(id, pred)`` under a model table."""
    rows = sized(texts.select(F.col(id_col), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    x = features(rows, "row", "text").join(model.select("word", "w"), "word")
    z = x.groupBy("row").agg(F.sum(F.col("x") * F.col("w")).alias("z"))
    return rows.join(z, "row", "left").select(id_col, (F.coalesce("z", F.lit(0.0)) > 0).cast("int").alias("pred"))


def draws(n: int, seed: int = 123, epochs: tuple[int, int] = (2, 15)) -> list[Settings]:
    """Seeded draws of the settings of ``n`` trials."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        out.append(Settings(lr=round(math.exp(rng.uniform(math.log(5e-3), math.log(1e-1))), 6), batches=rng.choice([2, 4]),
                            epochs=rng.randint(*epochs), warmup=rng.choice([0.0, 0.1])))
    return out


def search(train_rows: DataFrame, val: DataFrame, path: str, trials: list[Settings], **columns) -> DataFrame:
    """Train every trial, and record ``(trial, params, best_val_loss,
    warmup)`` in a CSV table that each trial appends to under its number. A
    search that is started again under ``path`` goes on where it stopped: its
    recorded trials are not trained again and are not recorded twice. All trials
    share the words of the texts; ``AT_ONCE`` of them run side by side, as the
    jobs of one step are too small to fill a cluster."""
    spark = train_rows.sparkSession
    table = f"{path.rstrip('/')}/trials"
    left = [(i, s) for i, s in enumerate(trials) if not files.exists(spark, f"{table}/_manifest/{i}")]
    texts = Texts(train_rows, val, **columns) if left else None

    def trial(i: int, s: Settings) -> None:
        best = Trainer(train_rows, val, f"{path.rstrip('/')}/trial={i}", s, texts=texts, **columns).run().agg(F.min("val_loss").alias("best_val_loss"))
        append_run(best.select(F.lit(i).alias("trial"), F.to_json(parameters(s)).alias("params"), "best_val_loss", F.lit(s.warmup).alias("warmup")), table, str(i))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in [pool.submit(trial, i, s) for i, s in left]:
            done.result()
    kind = "trial int, params string, best_val_loss double, warmup double"
    return read_runs(spark, table, kind).withColumn("params", F.from_json("params", "map<string,string>"))


def parameters(settings: Settings) -> Column:
    """The settings as a map column."""
    return F.create_map(*[F.lit(str(v)) for kv in asdict(settings).items() for v in kv])
