"""Problem 8: texts packed whole into containers of one fixed capacity.

Method: vector best fit. A container has residual capacities of tokens, documents and attention cost (sum of squared
lengths); items come in falling order of length, and each goes to the open container that can take it under every
constraint and keeps the least weighted norm of residual shares. Items are dealt by hash into groups of bounded size
with one mix of lengths, and every group is packed in its own task.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable


@dataclass(frozen=True)
class Limits:
    """Capacities of a container and their weights in the norm of the residual shares."""

    tokens: int = 2048
    documents: int = 512
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.02, 0.05)

    @property
    def piece(self) -> int:
        """The longest item that any container takes; only longer texts are cut."""
        return min(self.tokens, math.isqrt(self.attention))


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of a text; path is a file of ranks (.tiktoken), of a tokenizer (.json) or of a model (.model)."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda s: len(encoding.encode_ordinary(s))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda s: len(tokenizer.encode(s, add_special_tokens=False).ids)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda s: len(model.encode(s))


def token_counts(documents: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row; null and empty texts have no tokens."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or token_counter(path)
            sizes = [count(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def best_fit(sizes: np.ndarray, limits: Limits) -> np.ndarray:
    """The container of each item; sizes fall and are at most limits.piece."""
    weights = np.array(limits.weights)
    top = np.array([limits.tokens, limits.documents, limits.attention], float)
    left = np.empty((1024, 3))
    names = np.empty(1024, np.int64)
    out = np.empty(len(sizes), np.int64)
    smallest = sizes[::-1]
    n = made = 0
    for i, size in enumerate(sizes.tolist()):
        need = np.array([size, 1.0, size * size])
        rest = left[:n] - need
        share = rest / top
        cost = np.where((rest >= 0).all(axis=1), (share * share) @ weights, np.inf)
        k = int(cost.argmin()) if n else -1
        if k < 0 or cost[k] == np.inf:
            if n == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            k, n = n, n + 1
            left[k], names[k] = top, made
            made += 1
        left[k] -= need
        out[i] = names[k]
        # A container that can't take the least item still to come is closed.
        if left[k, 0] < smallest[0] or left[k, 1] < 1:
            n -= 1
            left[k], names[k] = left[n], names[n]
    return out


def pack(documents: DataFrame, limits: Limits = Limits(), tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", group_items: int = 20_000) -> DataFrame:
    """(container_id, doc_id, piece_no, token_start, n_tokens, place): one row per piece of every document.

    A text above limits.piece is cut into pieces of that size and a rest; any other is one piece, number 0. place is
    the token offset in the container. Texts without tokens need no container: their container_id and place are null.
    Equal ids are packed as documents of their own; an empty table gives no rows. ``group_items`` bounds what one task
    packs; every group leaves at most a few containers underfilled.
    """
    counted = durable(token_counts(documents, tokenizer, doc_id, text), "tokens")
    piece = limits.piece
    cut = F.when(F.col("n_tokens") > piece, F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / piece))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = counted.select("doc_id", "n_tokens", F.explode(cut).alias("piece_no")).select(
        "doc_id", "piece_no", (F.col("piece_no") * piece).alias("token_start"), F.least(F.col("n_tokens") - F.col("piece_no") * piece, F.lit(piece)).alias("n_tokens")
    )
    out = ["container_id", "doc_id", "piece_no", "token_start", "n_tokens", "place"]
    full = pieces.where(F.col("n_tokens") == piece).withColumns({"container_id": F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")), "place": F.lit(0).cast("long")})
    none = pieces.where("n_tokens = 0").withColumns({"container_id": F.lit(None).cast("string"), "place": F.lit(None).cast("long")})
    groups = max(1, -(-counted.count() // group_items))
    loose = pieces.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < piece)).withColumn("g", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], ignore_index=True)
        container = best_fit(frame["n_tokens"].to_numpy(), limits)
        frame["container_id"] = [f"{g}-{c}" for g, c in zip(frame["g"], container)]
        frame["place"] = frame.groupby(container)["n_tokens"].cumsum() - frame["n_tokens"]
        return frame[out]

    kind = documents.schema[doc_id].dataType.simpleString()
    # Groups are small in bytes and long in work: an explicit count keeps the runtime from merging them into few tasks.
    packed = loose.repartition(min(groups, 8192), "g").groupBy("g").applyInPandas(one, f"container_id string, doc_id {kind}, piece_no long, token_start long, n_tokens long, place long")
    return packed.unionByName(full.select(out)).unionByName(none.select(out))


def checked(documents: DataFrame, packed: DataFrame, limits: Limits, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: documents packed whole, texts cut though a container could take them, and containers over each limit (0 each if all is well)."""
    sizes = token_counts(documents, tokenizer, doc_id, text).withColumnRenamed("n_tokens", "size")
    pieces = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("packed"))
    both = sizes.join(pieces, "doc_id", "left").agg(F.count_if(F.col("size") == F.col("packed")).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= limits.piece)).alias("cut_below"))
    boxes = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("d"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("a"))
    over = boxes.agg(F.count_if(F.col("t") > limits.tokens).alias("over_tokens"), F.count_if(F.col("d") > limits.documents).alias("over_documents"), F.count_if(F.col("a") > limits.attention).alias("over_attention"))
    return both.crossJoin(over)  # two single rows
