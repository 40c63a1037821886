"""Exact deduplication by a tree merge of sorted digest runs.

Every partition of the input makes a run: the SHA-256 digests of its normalised texts (A-Z
lower-cased), sorted, each once, with the number of its rows and the row of them that stays. The
runs then meet in binomial rounds. In round r the partitions stand in blocks of RADIX**(r + 1);
each block has as many slices of the digest space, and a task merges one slice of RADIX runs into
one, so that every round has about as many tasks with about as much work as the first, no task
ever gets more than RADIX entries of one digest for each run it merges, and the last round leaves
one run, dealt over all tasks. Spark's external sort merges the runs that a task has received; a
pass over the sorted entries folds neighbours. Runs are sliced and ordered by a digest's first 64
bits, and entries are one only if all 256 bits agree: so each level verifies what it retains.

A run's entries keep the ids of their rows aside, in the table of the leaves. What the last round
found comes back to them by a join on the digest, in which a run has a digest once; digests of very
many rows come by broadcast instead (see tables.looked_up).

Defined cases: a null text counts as empty; a null key is after all others, so a row without a key
stays only where its group has none with one; of rows with the same key and text, the first that
was read stays, so each group keeps exactly one row; repeated rows count as often as they stand
there; an empty table gives an empty result; columns besides the key and the text are not read.
Keys are whole numbers, else TypeError. Texts are hashed whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import cut, hot_above, looked_up, whole_key

DIGEST = ["d0", "d1", "d2", "d3"]
_ENTRY = "d0 long, d1 long, d2 long, d3 long, node int, id long, at long, n long"
#: Runs that one task merges in a round: 2**RADIX_BITS.
RADIX_BITS = 3
#: Rows that a leaf sorts at once; a run may come in several such pieces.
LEAF_ROWS = 1 << 17
#: Rows of one partition are numbered below this.
_PLACES = 1 << 40


def leaves(documents: DataFrame, *, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The sorted run of each partition, `node` being its number: entries of _ENTRY with `ids` and `places` of all their rows. (id, at) is the row that stays."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
    rows = documents.select(whole_key(documents, key).alias("id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, read = TaskContext.get().partitionId(), 0
        digests, ids, known, held = [], [], [], 0
        for b in batches:
            digests.append(b"".join(hashlib.sha256((x.as_py() or b"").lower()).digest() for x in b.column("text")))
            ids.append(b.column("id").fill_null(0).to_numpy(zero_copy_only=False))
            known.append(b.column("id").is_valid().to_numpy(zero_copy_only=False))
            held += b.num_rows
            if held >= LEAF_ROWS:
                yield _piece(node, read, digests, ids, known, keep)
                read, held, digests, ids, known = read + held, 0, [], [], []
        if held:
            yield _piece(node, read, digests, ids, known, keep)

    return rows.mapInArrow(run, f"{_ENTRY}, ids array<long>, places array<long>")


def _piece(node: int, first: int, digests: list[bytes], ids: list[np.ndarray], known: list[np.ndarray], keep: str) -> pa.RecordBatch:
    d = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 4)
    id_, real = np.concatenate(ids), np.concatenate(known)
    at = node * _PLACES + first + np.arange(len(d))
    rank = ~id_ if keep == "largest" else id_  # ~ turns the order round and can't overflow
    order = np.lexsort((at, rank, ~real, d[:, 3], d[:, 2], d[:, 1], d[:, 0]))
    d, at = d[order], at[order]
    own = pa.array(id_[order], mask=~real[order])
    start = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]).any(axis=1)])
    cuts = pa.array(np.r_[start, len(d)].astype(np.int32))
    columns = [*(pa.array(d[start, i]) for i in range(4)), pa.array(np.full(len(start), node, np.int32)), own.take(pa.array(start)), pa.array(at[start]), pa.array(np.diff(np.r_[start, len(d)]))]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(cuts, own), pa.ListArray.from_arrays(cuts, pa.array(at))], names=[*DIGEST, "node", "id", "at", "n", "ids", "places"])


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring entries of one node and digest as one: the first of them, with the sum of all their rows. Only the last entry is held from batch to batch."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        keys = np.column_stack([t.column(c).to_numpy() for c in ("node", *DIGEST)])
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        n = np.add.reduceat(t.column("n").to_numpy(), start)
        t = t.take(pa.array(start)).set_column(t.schema.get_field_index("n"), "n", pa.array(n))
        held = t.slice(len(start) - 1)
        yield from t.slice(0, len(start) - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def merge_round(level: DataFrame, round_: int, *, keep: str = "smallest") -> DataFrame:
    """The runs of a level, RADIX of them merged into one; in each block slices of the digest space go to tasks of their own."""
    width = RADIX_BITS * (round_ + 1)
    entries = level.select(*DIGEST, F.shiftright("node", RADIX_BITS).alias("node"), "id", "at", "n", F.shiftrightunsigned("d0", 64 - width).alias("slice"))
    preferred = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    dealt = entries.repartition("node", "slice").sortWithinPartitions("node", *DIGEST, preferred, "at")
    return dealt.select(*level.columns).mapInArrow(fold, _ENTRY)


def exact_groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """Rows (key, keep_id, group_size, kept, text_sha256), one for each row of `documents`: keep_id is the smallest or largest key of the rows with its text."""
    runs = cut(leaves(documents, key=key, text=text, keep=keep))
    # Three numbers come to the driver: the runs, their rows, and (by it) how many rows of a digest are many.
    last, total = runs.agg(F.max("node"), F.sum("n")).first()
    level, round_ = runs.select(*[c for c in runs.columns if c not in ("ids", "places")]), 0
    while (last or 0) >> (RADIX_BITS * round_) or not round_:
        level = merge_round(level, round_, keep=keep)
        round_ += 1
    # Only texts that stand there more than once need to be told so.
    roots = level.where("n > 1").select(*DIGEST, F.struct("id", "at", "n").alias("found"), "n")
    whole = cut(roots)
    own = runs.select(*DIGEST, "node", F.arrays_zip("ids", "places").alias("rows"))
    told = looked_up(own, whole, DIGEST, "found", "node", hot_above(total or 0))
    each = told.select(*DIGEST, "found", F.explode("rows").alias("r"))
    alone = F.col("found").isNull()
    return each.select(
        F.col("r.ids").alias(key), F.when(alone, F.col("r.ids")).otherwise(F.col("found.id")).alias("keep_id"), F.coalesce("found.n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("found.at") == F.col("r.places"))).alias("kept"), F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in DIGEST])).alias("text_sha256"),
    )


def without_copies(documents: DataFrame, *, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of each group of equal texts, with all its columns. Rows that share key and text with the one that stays can't be told from it and stay with it."""
    groups = exact_groups(documents, key=key, text=text, keep=keep).where("kept").select(F.col(key).alias("id"), "text_sha256")
    normal = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = documents.select(F.struct("*").alias("row"), F.col(key).alias("own_id"), F.sha2(F.encode(normal, "UTF-8"), 256).alias("own_sha256"))
    return rows.join(groups, rows["own_id"].eqNullSafe(groups["id"]) & (rows["own_sha256"] == groups["text_sha256"]), "left_semi").select("row.*")
