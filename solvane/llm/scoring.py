"""Scores of texts by a language model that learns from the training documents of the whole corpus.

Texts are packed into parcels: the distinct words of a parcel, and every token as a number among them. Words are counted over
all parcels in the order of words; a parcel gets back the counts of those of its words that other parcels hold too, so that
no task holds the corpus's words. The most frequent words are classes of their own; all others, however many, are classed by the magnitude of
their count. A word's probability is that of its class after the two classes before, by the log-bilinear model, times the word's
share of its class's tokens. Words that training never met are one word more in the class of those met once.

A round of training sends the model to all tasks. Each trains on all its training tokens, and the weighted mean of what the
tasks return is the next model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvane.llm.bilinear import Bilinear, Trainer, contexts
from solvane.llm.words import gathered, starts_of
from solvane.storage import WIDE_ROWS, rows_at_once, stage

PARCEL = 6 << 20  # text in a parcel, unless one text has more
TEXTS = 200  # texts that are sent to Python at once
PACK = 500_000  # counts that are packed at once
SINGLE = 1000  # words that are classes of their own
MAGNITUDES = 64  # classes of the others: counts from 2^i to 2^(i + 1) - 1
ROUNDS = 2
BLOCK = 4096  # numbers of the model that are averaged together
END = b""  # the token after the last word; words are never empty
COUNTED = pa.schema({"parcel": pa.int64(), "at": pa.binary(), "c": pa.binary(), "totals": pa.list_(pa.int64()), "members": pa.list_(pa.int64()), "words": pa.list_(pa.string())})


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each parcel: (parcel, ids, held, lengths, words, own, low, high).

    ``words`` are a parcel's distinct words, the most frequent first, ``own`` their counts in its training texts; ``low`` and
    ``high`` are the halves of every token's place among them.
    """
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(F.col(id_col)).alias("held"))

    def batches(parts):
        for part in gathered(parts, "text", PARCEL):
            numbers: dict[bytes, int] = {END: 0}
            streams = []
            for text in part.column("text").cast(pa.binary()):
                words = text.as_py().lower().split()
                streams.append(np.array([numbers.setdefault(w, len(numbers)) for w in words] + [0], np.uint32))
            held = part.column("held")
            training = [s for s, h in zip(streams, held.to_pylist(), strict=True) if not h]
            own = np.bincount(np.concatenate(training), minlength=len(numbers)) if training else np.zeros(len(numbers), np.int64)
            stream = np.concatenate(streams)
            order = np.argsort(-np.bincount(stream, minlength=len(numbers)), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            stream = place[stream]
            words = pa.array(list(numbers), pa.binary()).cast(pa.string()).take(pa.array(order))
            lists = [part.column("id"), held, pa.array([len(s) for s in streams], pa.int64()), words, pa.array(own[order], pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*(pa.ListArray.from_arrays([0, len(x)], x) for x in lists), *(pa.array([(stream >> shift).astype(np.uint16).tobytes()], pa.binary()) for shift in (0, 16))],
                ["ids", "held", "lengths", "words", "own", "low", "high"],
            )

    kind = read.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, held array<boolean>, lengths array<bigint>, words array<string>, own array<int>, low binary, high binary"
    with rows_at_once(docs.sparkSession, sent=TEXTS):
        return stage(read.mapInArrow(batches, schema).withColumn("parcel", F.monotonically_increasing_id()), "parcels", **WIDE_ROWS)


def magnitudes(counts: np.ndarray) -> np.ndarray:
    """i for counts from 2^i to 2^(i + 1) - 1, and 0 for 0."""
    return np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1


def count_words(parcels: DataFrame, single: int) -> DataFrame:
    """The counts of words over all parcels, in one table of three kinds of rows.

    (parcel, at, c): packed, for words of a parcel the count in the corpus where it isn't the parcel's own; (totals, members):
    tokens and words of each magnitude; (words, c): the most frequent words. Rows come sorted by word, so that a task
    holds the rows of one word at a time, at most one for each parcel, and packs what it has found when that is much.
    """
    asked = parcels.select("parcel", F.posexplode(F.arrays_zip("words", "own")).alias("at", "e")).select("parcel", "at", F.col("e.words").alias("word"), F.col("e.own").alias("own"))
    dealt = asked.repartition("word").sortWithinPartitions("word")

    def packed(found):
        parcel, at, c = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(parcel, kind="stable")
        parcel, at, c = parcel[order], at[order], c[order]
        bounds = np.append(np.flatnonzero(np.diff(parcel, prepend=parcel[0] - 1)), len(parcel))
        for low, high in zip(bounds, bounds[1:], strict=False):
            yield {"parcel": int(parcel[low]), "at": at[low:high].astype(np.int32).tobytes(), "c": c[low:high].tobytes()}

    def batches(parts):
        totals, members = np.zeros(MAGNITUDES, np.int64), np.zeros(MAGNITUDES, np.int64)
        found, held, top = [], 0, []

        def told(word, c):  # words that are complete, and their counts
            nonlocal top
            met = c > 0
            np.add.at(totals, magnitudes(c[met]), c[met])
            np.add.at(members, magnitudes(c[met]), 1)
            least = -top[-1][0] if len(top) >= single else 1
            some = np.flatnonzero(c >= least)
            top += [(-int(c[i]), word[i].as_py()) for i in some.tolist()]
            if len(some):
                top = sorted(top)[:single]

        def rows_of(word, rows, c, lengths):
            nonlocal held
            told(word, c)
            c = np.repeat(c, lengths)
            other = np.flatnonzero(c != rows[2])
            if len(other):
                found.append((rows[0][other], rows[1][other], c[other]))
                held += len(other)

        open_word, open_rows = None, []
        for part in parts:
            rows = [part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("parcel", "at", "own")]
            runs = pc.run_end_encode(part.column("word"))
            ends, words = runs.run_ends.to_numpy().astype(np.int64), runs.values
            if not len(words):
                continue
            if open_rows and words[0].as_py() == open_word:  # the open word goes on
                open_rows.append([r[: ends[0]] for r in rows])
                rows, ends, words = [r[ends[0] :] for r in rows], ends[1:] - ends[0], words[1:]
                if not len(words):
                    continue
            if open_rows:
                whole = [np.concatenate(r) for r in zip(*open_rows, strict=True)]
                rows_of(pa.array([open_word]), whole, whole[2].sum(keepdims=True), np.array([len(whole[0])]))
            starts = np.append(0, ends)
            last = starts[-2]
            if last:
                rows_of(words[:-1], [r[:last] for r in rows], np.add.reduceat(rows[2][:last], starts[:-2]), np.diff(starts[:-1]))
            open_word, open_rows = words[-1].as_py(), [[r[last:] for r in rows]]
            if held > PACK:
                yield pa.RecordBatch.from_pylist(list(packed(found)), COUNTED)
                found.clear()
                held = 0
        if open_rows:
            whole = [np.concatenate(r) for r in zip(*open_rows, strict=True)]
            rows_of(pa.array([open_word]), whole, whole[2].sum(keepdims=True), np.array([len(whole[0])]))
        if found:
            yield pa.RecordBatch.from_pylist(list(packed(found)), COUNTED)
        counts = np.array([-c for c, _ in top], np.int64).tobytes()
        yield pa.RecordBatch.from_pylist([{"totals": totals.tolist(), "members": members.tolist()}, {"words": [w for _, w in top], "c": counts}], COUNTED)

    with rows_at_once(parcels.sparkSession, read=1):
        return stage(dealt.mapInArrow(batches, "parcel bigint, at binary, c binary, totals array<bigint>, members array<bigint>, words array<string>"), "counted")


class Classes:
    """Which class a word is in, and its share of the class, both by its count in training."""

    def __init__(self, single: dict[str, int], totals: np.ndarray, members: np.ndarray):
        self.tokens, self.words = int(totals.sum()), int(members.sum())
        self.least = min(single.values(), default=1)
        counts = np.array([*single.values()], np.int64)
        totals, members = totals.copy(), members.copy()
        np.subtract.at(totals, magnitudes(counts), counts)
        np.subtract.at(members, magnitudes(counts), 1)
        members[0] += 1  # the word that training never met
        totals[0] += 1
        used = np.flatnonzero(members > 0)
        self.at = np.full(MAGNITUDES, -1)
        self.at[used] = len(single) + np.arange(len(used))
        self.totals = totals
        self.frequency = np.concatenate([counts, totals[used]]).astype(np.float64)
        self.place = {w: i for i, w in enumerate(single)}

    def of(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and log10 of the share in it."""
        magnitude = magnitudes(counts)
        classes = self.at[magnitude]
        share = np.log10(np.maximum(counts, 1) / np.maximum(self.totals[magnitude], 1))
        for i in np.flatnonzero(counts >= self.least).tolist():
            place = self.place.get(words[i].as_py())
            if place is not None:
                classes[i], share[i] = place, 0.0
        return classes, share


def classes_of(counted: DataFrame, single: int = SINGLE) -> Classes:
    """From ``count_words``: the end token and the most frequent words, and the sums of the magnitudes."""
    sums = {"totals": np.zeros(MAGNITUDES, np.int64), "members": np.zeros(MAGNITUDES, np.int64)}
    for name, into in sums.items():
        cells = counted.where(F.col(name).isNotNull()).select(F.posexplode(name).alias("m", "n"))
        for row in cells.groupBy("m").agg(F.sum("n").alias("n")).collect():
            into[row.m] = row.n

    def unpacked(parts):
        for part in parts:
            for words, c in zip(part.column("words"), part.column("c"), strict=True):
                yield pa.RecordBatch.from_arrays([words.values, pa.array(np.frombuffer(c.as_buffer(), np.int64))], ["word", "c"])

    top = counted.where("words is not null").select("words", "c").mapInArrow(unpacked, "word string, c bigint")
    first = top.orderBy(F.col("word") != END.decode(), F.desc("c"), "word").limit(single).collect()
    return Classes({row.word: row.c for row in first}, **sums)


def code(parcels: DataFrame, counted: DataFrame, classes: Classes, id_type: str) -> DataFrame:
    """Parcels with the class of every token, and for each text what does not depend on the context."""
    packets = counted.where("parcel is not null").groupBy("parcel").agg(F.collect_list(F.struct("at", "c")).alias("packets"))  # of one parcel's words
    whole = parcels.join(packets, "parcel", "left")
    sent = parcels.sparkSession.sparkContext.broadcast(classes)  # at most SINGLE words and their counts

    def batches(parts):
        told = sent.value
        for part in parts:
            for i in range(len(part)):
                c = part.column("own")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                for packet in part.column("packets")[i].as_py() or []:
                    c[np.frombuffer(packet["at"], np.int32)] = np.frombuffer(packet["c"], np.int64)
                of, share = told.of(part.column("words")[i].values, c)
                low, high = (np.frombuffer(part.column(k)[i].as_buffer(), np.uint16).astype(np.uint32) for k in ("low", "high"))
                stream = low | high << np.uint32(16)
                heads = starts_of(part.column("lengths")[i].values.to_numpy(zero_copy_only=False))[:-1]
                base = np.log10((c + 1) / (told.tokens + told.words + 1))
                lists = [pa.array(np.add.reduceat(x[stream], heads)) for x in ((c > 0).astype(np.int64), base, share)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).slice(i, 1) for k in ("ids", "held", "lengths")), *(pa.ListArray.from_arrays([0, len(v)], v) for v in lists), pa.array([of.astype(np.uint16)[stream].tobytes()], pa.binary())],
                    ["ids", "held", "lengths", "known", "base", "share", "classes"],
                )

    schema = f"ids array<{id_type}>, held array<boolean>, lengths array<bigint>, known array<bigint>, base array<double>, share array<double>, classes binary"
    with rows_at_once(parcels.sparkSession, read=1, sent=1):
        return stage(whole.mapInArrow(batches, schema), "coded", **WIDE_ROWS)


def train(coded: DataFrame, model: Bilinear, rounds: int = ROUNDS) -> Bilinear:
    """The model after ``rounds`` passes over all training tokens."""
    spark = coded.sparkSession
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)  # of fixed size

        def batches(parts, sent=sent, turn=turn):
            trainer = None
            for part in parts:
                for i in range(len(part)):
                    lengths = part.column("lengths")[i].values.to_numpy(zero_copy_only=False)
                    learn = ~part.column("held")[i].values.to_numpy(zero_copy_only=False)
                    classes = np.frombuffer(part.column("classes")[i].as_buffer(), np.uint16)[np.repeat(learn, lengths)].astype(np.int64)
                    if not len(classes):
                        continue
                    if trainer is None:
                        own = Bilinear(sent.value.noise).load(sent.value.flat())
                        trainer = Trainer(own, seed=turn)
                    trainer.train(classes, *contexts(classes, lengths[learn], len(own.noise)))
            if trainer is not None:
                flat = trainer.model.flat().astype(np.float64) * trainer.seen
                blocks = [flat[a : a + BLOCK] for a in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([trainer.seen] * len(blocks)), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "weight", "numbers"])

        found = coded.select("held", "lengths", "classes").mapInArrow(batches, "block int, weight bigint, numbers binary")

        def add_up(parts):
            sums: dict[int, list] = {}
            for part in parts:
                for block, weight, numbers in zip(part.column("block").to_pylist(), part.column("weight").to_pylist(), part.column("numbers"), strict=True):
                    held = sums.setdefault(block, [0, 0.0])
                    held[0] += weight
                    held[1] = held[1] + np.frombuffer(numbers.as_buffer())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.int64()), pa.array([n.tobytes() for _, n in sums.values()], pa.binary())], ["block", "weight", "numbers"]
            )

        with rows_at_once(spark, read=1, sent=1):
            means = found.repartition("block").mapInArrow(add_up, "block int, weight bigint, numbers binary").orderBy("block").collect()  # the model's size
        if not means:
            return model
        model = Bilinear(model.noise).load(np.concatenate([np.frombuffer(r.numbers) / r.weight for r in means]))
    return model


def normalisers(spark, model: Bilinear) -> np.ndarray:
    """The logarithm of the sum over all classes for every pair of classes before; a row for each last class."""
    sent = spark.sparkContext.broadcast(model)

    def batches(parts):
        for part in parts:
            rows = sent.value.normaliser(part.column("id").to_numpy())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "sums"])

    rows = spark.range(len(model.context)).mapInArrow(batches, "id bigint, sums binary").orderBy("id").collect()
    return np.stack([np.frombuffer(r.sums, np.float32) for r in rows])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", single: int = SINGLE, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    A null or empty text is the end token alone. A null id counts as an empty text where documents are held out. Repeated
    rows are rows of their own and train as often as they come. Without training documents every word is the one
    that training never met, and both scores are 0. An empty table gives an empty result. Extra columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parcels = pack(docs, id_col, text_col)
    counted = count_words(parcels, single)
    classes = classes_of(counted, single)
    coded = code(parcels, counted, classes, kind)
    model = train(coded, Bilinear(classes.frequency), rounds)
    sent = spark.sparkContext.broadcast((*model.tables(), normalisers(spark, model)))  # squares of the number of classes
    tokens, start = classes.tokens, len(classes.frequency)

    def batches(parts):
        by_last, by_before, sums = sent.value
        for part in parts:
            for i in range(len(part)):
                lengths, known, base, share = (part.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("lengths", "known", "base", "share"))
                own = np.frombuffer(part.column("classes")[i].as_buffer(), np.uint16).astype(np.int64)
                last, before = contexts(own, lengths, start)
                chosen = by_last[last, own].astype(np.float64) + by_before[before, own] - sums[last, before]
                score = np.add.reduceat(chosen, starts_of(lengths)[:-1]) / np.log(10) + share
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [part.column("ids")[i].values, part.column("held")[i].values, pa.array(lengths), pa.array(known), pa.array(np.full(n, tokens)), pa.array(base), pa.array(score)],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    with rows_at_once(spark, read=1, sent=1):
        scored = stage(coded.mapInArrow(batches, schema), "scores")
    return scored.withColumnRenamed("id", id_col)
