"""Balanced label propagation: documents into shards of equal counts, equal texts together where they fit.

Documents with equal texts are linked. They start in shards drawn at random. A turn counts, for each text, its documents
in each shard; those outside the shard that draws the text wish to go there. Wishes are granted as far as a shard has room
or gives documents away in the same turn, be it to the shard they come from or around several shards, the strongest pulls
first. The first turns let a text gather where it can be held whole; in later ones documents go only to where at least as
many of their text are, so that the sum of the squared counts grows with every move and the turns come to an end: when
none of a row of them, each with other draws, grants a move. As linked documents are alike, a turn works on counts
(text, shard, documents), and a text's documents are told apart only at the end, by their rank. What then exceeds a
shard's quota and the documents without a link fill what is free. Loads, room and wishes are a number for each shard or
pair of shards; all else stays in tables.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvane.llm.ranks import running, shuffled
from solvane.storage import stage

SHARDS, ROUNDS = 24, 8
PULLS = 40  # classes of pull: powers of two of the neighbours in the shard wanted
IDLE = 6  # turns without a move after which none is left: two of each way to draw


def circulation(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents of each wish (from, to) may go, so that no shard gains more than its room."""
    spare = len(room)  # takes what fits into the room of a shard, and gives in place of any shard
    left: list[dict[int, int]] = [{} for _ in range(spare + 1)]
    for (a, b), n in wishes.items():
        left[a][b] = n
    for s, r in enumerate(room):
        if r > 0:
            left[s][spare] = r
        left[spare][s] = 1 << 62
    for a, b in wishes:
        while left[a][b]:
            before, queue = {b: a}, deque([b])
            while queue and a not in before:
                u = queue.popleft()
                for v, n in left[u].items():
                    if n and v not in before:
                        before[v] = u
                        queue.append(v)
            if a not in before:
                break
            ring, v = [(a, b)], a
            while v != b:
                ring.append((before[v], v))
                v = before[v]
            least = min(left[u][v] for u, v in ring)
            for u, v in ring:
                left[u][v] -= least
    return {(a, b): n - left[a][b] for (a, b), n in wishes.items() if n > left[a][b]}


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move counts ``n`` of (text, shard) until no move is left, within ``quotas``.

    For ``rounds`` turns a text is drawn by the shard that can hold most of it, even from where more of it are.
    """
    text = Window.partitionBy("text")  # a row for each shard at most
    shards, turn, idle = len(quotas), 0, 0
    while idle < IDLE:
        loads = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
        free = [max(0, q - loads.get(s, 0)) for s, q in enumerate(quotas)]
        room = F.array(*(F.lit(r).cast("bigint") for r in free))
        over = F.array(*(F.lit(loads.get(s, 0) > q) for s, q in enumerate(quotas)))
        gain = F.least(F.element_at(room, F.col("shard") + 1), F.sum("n").over(text) - F.col("n"))
        held = F.when(gain > 0, F.col("n") + gain).otherwise(0)  # first where there is room
        tie = F.xxhash64("text", "shard", F.lit(turn))
        late = turn >= rounds
        ways = [[held.alias("held"), "n", tie.alias("tie"), "shard"], ["n", tie.alias("tie"), "shard", held.alias("held")], [tie.alias("tie"), "n", "shard", held.alias("held")]]
        scored = cells.withColumn("score", F.struct(*ways[turn % 3 if late else 0]))
        scored = scored.withColumn("best", F.max("score").over(text)).select("text", "shard", "n", F.col("best.shard").alias("to"), F.col("best.n").alias("pull"), F.col("best.held").alias("held"))
        goes = F.col("n") <= F.col("pull")
        if not late:
            goes = goes | (F.col("n") <= F.col("held") * 0.75) | F.element_at(over, F.col("shard") + 1)
        moves = scored.where((F.col("shard") != F.col("to")) & goes)
        moves = moves.withColumn("class", F.least(F.floor(F.log2("pull")), F.lit(PULLS)).cast("int"))
        asked = moves.groupBy("shard", "to", "class").agg(F.sum("n").alias("asked"))
        wishes: dict[tuple[int, int], int] = {}
        for r in asked.collect():  # pairs of shards times classes of pull at most
            wishes[r.shard, r.to] = wishes.get((r.shard, r.to), 0) + r.asked
        granted = circulation(dict(sorted(wishes.items())), free)
        turn, idle = turn + 1, 0 if granted else idle + 1 if late else idle
        if not granted:
            turn = max(turn, rounds) if not late else turn
            continue
        # the strongest pulls first; of the class that no longer goes whole a part, in an order drawn at random
        lane = F.col("shard") * shards + F.col("to")
        grants = F.array(*(F.lit(granted.get((a, b), 0)).cast("bigint") for a in range(shards) for b in range(shards)))
        before = F.sum("asked").over(Window.partitionBy("shard", "to").orderBy(F.desc("class"))) - F.col("asked")
        asked = asked.withColumn("grant", F.element_at(grants, lane + 1) - before).where("grant > 0").select("shard", "to", "class", "grant")
        moves = moves.join(F.broadcast(asked), ["shard", "to", "class"])
        moves = moves.select("text", "shard", "to", "n", "grant", (lane * (PULLS + 1) + F.col("class")).alias("lane"), shuffled(F.col("text"), F.lit(turn)).alias("order"))
        moves = running(moves, "lane", "order", "taken", F.col("n"))
        moves = moves.withColumn("k", F.least("n", F.col("grant") - F.col("taken"))).where("k > 0")
        changes = F.explode(F.array(F.struct("shard", (-F.col("k")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("k").alias("n"))))
        changed = cells.unionByName(moves.select("text", changes.alias("c")).select("text", "c.shard", "c.n"))
        cells = stage(changed.groupBy("text", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
    return cells


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    The law is "rows": counts of documents differ by one at most, the lower shards having the larger ones. ``size`` is
    the text's bytes plus 8. A null text counts as empty, and linked with empty ones. Slots number a shard's documents from 0.
    ``grown_shard`` belongs to another law and is null. Null ids and repeated rows are placed like all others; other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("text"),
    ).withColumn("order", shuffled(F.col("id"), F.col("text")))
    slim = stage(slim, "documents")
    total = slim.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    first = F.pmod(F.col("order"), F.lit(shards)).cast("int")
    cells = stage(slim.groupBy("text", first.alias("shard")).agg(F.count("*").alias("n")), "cells")
    copies = cells.groupBy("text").agg(F.sum("n").alias("copies"))
    linked = stage(copies.where("copies > 1"), "linked")
    cells = propagate(cells.join(linked.select("text"), "text"), quotas, rounds)

    # documents of a linked text fill the text's shards in turn, by rank
    ends = F.sum("n").over(Window.partitionBy("text").orderBy("shard"))
    spans = cells.withColumn("end", ends).groupBy("text").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("spans"))  # a shard each at most
    member = slim.select("id", "order", "size", "text_crc32", "text").join(linked, "text", "left")
    apart = member.where("copies is null").withColumn("shard", F.lit(-1))
    together = running(member.where("copies is not null"), "text", "order", "rank").join(spans, "text")
    shard = F.filter("spans", lambda s: s["end"] > F.col("rank"))[0]["shard"]
    own = ["id", "order", "size", "text_crc32", "shard"]
    placed = stage(together.withColumn("shard", shard).select(*own), "placed")

    slots = stage(running(placed, "shard", "order", "slot"), "slots")
    quota = F.element_at(F.array(*(F.lit(q).cast("bigint") for q in quotas)), F.col("shard") + 1)
    kept = slots.where(F.col("slot") < quota)
    loads = {r.shard: r.n for r in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    pool = running(slots.where(F.col("slot") >= quota).select(*own).unionByName(apart.select(*own)).withColumn("all", F.lit(0)), "all", "order", "rank")
    ends_of, end = [], 0
    for s, q in enumerate(quotas):
        end += q - loads.get(s, 0)
        ends_of.append((end, s, loads.get(s, 0) - (end - (q - loads.get(s, 0)))))
    table = F.array(*(F.struct(F.lit(e).cast("bigint").alias("end"), F.lit(s).alias("shard"), F.lit(d).cast("bigint").alias("shift")) for e, s, d in ends_of))
    filled = pool.withColumn("to", F.filter(table, lambda s: s["end"] > F.col("rank"))[0])
    filled = filled.select("id", "size", "text_crc32", F.col("to.shard").alias("shard"), (F.col("rank") + F.col("to.shift")).alias("slot"))
    out = kept.select("id", "size", "text_crc32", "shard", "slot").unionByName(filled)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
