"""Operator 3: token counts as delta-maintained rollups.

A change is one document's count before and after under one tokenizer version: an insert has no count before, a
delete none after, a revision both. Each change becomes signed rows, -1 document and its tokens for what was and
+1 for what is, and these add up by source, language and tokenizer version. A third of all rows in one source is no
matter: sums are combined before the shuffle.

A batch's sums are written to a folder of their own, and the batch is committed by one small file that may be created
only once, which names that folder and the sums' digest. So a batch is there as a whole or not at all, of two writers
one commits, a batch that is committed again (a retry, a lost executor, a replay) changes nothing, and one with the name
of another but other sums is refused. ``compact`` folds all committed batches into maintained totals, under a number
that is taken in the same way; totals are the last of these and the batches since.

Defined results: null sources and languages are groups of their own; null texts count no tokens; a change
without a count before and after is nothing; groups whose documents have all gone have zeros; batches are named
by letters, digits, ``-`` and ``_``; a commit whose writer was lost while it created the small file counts nothing, and
its name is free again after ``release``.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """Additive totals under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Add a batch of changes: source, lang, tokenizer, tokens_before, tokens_after."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        signed = changes.select(*KEYS, F.inline(F.array(*(F.struct(F.lit(sign).cast("long").alias("sign"), F.col(c).cast("long").alias("tokens")) for sign, c in ((-1, "tokens_before"), (1, "tokens_after"))))))
        signed = signed.filter("tokens is not null").groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
        data = self._write(signed, batch)
        row = self._read([data]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("*").cast("decimal(38,0)")).alias("sum")).first()
        digest = f"{row.n}:{row.sum}"
        if self._create(f"batches/{batch}", {"data": data, "digest": digest}):
            return
        self._delete(data)
        there = self._told(f"batches/{batch}")
        if there is None:
            raise RuntimeError(f"batch {batch!r} is being committed; if its writer is lost, release it")
        if there["digest"] != digest:
            raise ValueError(f"batch {batch!r} was committed with other rows")

    def release(self, batch: str) -> None:
        """Free the name of a batch whose writer was lost while it committed; a committed batch stays."""
        if batch in self._names("batches") and self._told(f"batches/{batch}") is None:
            self._delete(f"batches/{batch}")

    def compact(self) -> None:
        """Fold the committed batches into maintained totals; another writer that does so first wins.

        What the totals before had folded is deleted: readers that began with them have had the time since then.
        """
        number, base = self._base()
        batches = self._since(base)
        if not batches:
            return
        data = self._write(self._sums([base["data"], *batches.values()]), "totals")
        folded = {"data": data, "batches": sorted({*base["batches"], *batches}), "old": [base["data"], *batches.values()]}
        if not self._create(f"totals/{number + 1:08d}", folded):
            self._delete(data)
            return
        for old in base["old"]:
            self._delete(old)

    def totals(self) -> DataFrame:
        _, base = self._base()
        return self._sums([base["data"], *self._since(base).values()])

    def _sums(self, folders: list[str]) -> DataFrame:
        return self._read(folders).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def _base(self) -> tuple[int, dict]:
        """The last maintained totals and their number."""
        for name in sorted(self._names("totals"), reverse=True):
            if (told := self._told(f"totals/{name}")) is not None:
                return int(name), told
        return 0, {"data": "", "batches": [], "old": []}

    def _since(self, base: dict) -> dict[str, str]:
        """The folders of the batches that these totals don't hold."""
        told = {name: self._told(f"batches/{name}") for name in self._names("batches") - set(base["batches"])}
        return {name: t["data"] for name, t in sorted(told.items()) if t is not None}

    def _write(self, rows: DataFrame, name: str) -> str:
        data = f"data/{name}-{uuid.uuid4().hex}"
        rows.repartition(1).write.parquet(f"{self.folder}/{data}")
        return data

    def _read(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{f}" for f in folders if f]
        return self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)

    def _files(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, kind: str) -> set[str]:
        fs, place = self._files(kind)
        return {s.getPath().getName() for s in fs.listStatus(place)} if fs.exists(place) else set()

    def _create(self, name: str, told: dict) -> bool:
        """Whether the file is new and ours."""
        fs, place = self._files(name)
        try:
            out = fs.create(place, False)
        except Py4JJavaError:
            if fs.exists(place):
                return False
            raise
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        return True

    def _told(self, name: str) -> dict | None:
        """What a small file tells; None while its writer hasn't closed it."""
        fs, place = self._files(name)
        jvm = self.spark._jvm.java.io
        reader = jvm.BufferedReader(jvm.InputStreamReader(fs.open(place), "UTF-8"))
        line = reader.readLine()
        reader.close()
        return json.loads(line) if line else None

    def _delete(self, name: str) -> None:
        if name:
            fs, place = self._files(name)
            fs.delete(place, True)


def _counter(kind: str, path: str):
    if kind == "pieces":
        from .sentencepiece_codec import Codec

        codec = Codec(path)
        return lambda texts: [len(ids) - 2 for ids, _, _ in codec.encode_all(texts)]
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(coder.encode_ordinary(t)) for t in texts]


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[str, str]], text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens; tokenizers: version name to (``pieces`` or ``ranks``, path)."""
    names = list(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_counter(*tokenizers[n]) for n in names]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(3).to_pylist()]
                for name, counter in zip(names, counters, strict=True):
                    columns = [*part.columns[:3], pa.array([name] * len(texts), pa.string()), pa.array(counter(texts), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    chosen = docs.select("doc_id", "source", "lang", F.col(text_col).alias("text"))
    id_type = dict(docs.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {id_type}, source string, lang string, tokenizer string, n_tokens long")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("tokens_before", F.lit(None).cast("long")).withColumnRenamed("n_tokens", "tokens_after")


def deleted(counts: DataFrame) -> DataFrame:
    return counts.withColumnRenamed("n_tokens", "tokens_before").withColumn("tokens_after", F.lit(None).cast("long"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from counts before and after of the same documents."""
    new = after.select("doc_id", "tokenizer", F.col("n_tokens").alias("tokens_after"))
    return before.withColumnRenamed("n_tokens", "tokens_before").join(new, ["doc_id", "tokenizer"])
