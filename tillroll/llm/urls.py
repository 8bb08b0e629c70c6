"""URL filter: a list of any size as sorted digests that tasks map into memory and search.

A rule is a host and the start of a path; it fits its host and all subdomains.
A list is files in the shared folder. Each holds, for a range of 64-bit
xxhash digests of host + path, the sorted digests, the strings themselves and
their actions. A url is taken apart into the strings that could be rules, whose
digests are searched for; a hit counts only if the stored string is equal.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import large_batches, prepare, table
from tillroll.llm.tokenstore import _store
from tillroll.session import new_path

MAGIC = b"URLS0001"
#: Spark's xxhash64 of one string is the 64-bit xxhash with this seed.
SEED = 42
#: Rules of one file, at most: what a task holds at a time where files can't be mapped.
FILE_RULES = 4_000_000
#: Rules the query judges by, as (host, path, action).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = """
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), named AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path
    FROM parts
), judged AS (
    SELECT page_id, host, path, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM named
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


# ---------------------------------------------------------------- the list


def _file(digests: np.ndarray, rules: pa.Array, hosts: np.ndarray, blocked: np.ndarray) -> Iterator[bytes]:
    """One file of the list, piece by piece."""
    sizes = pc.binary_length(rules).to_numpy(zero_copy_only=False).astype(np.int64)
    shapes = np.unique(np.stack([hosts, sizes - hosts], axis=1), axis=0)
    parts = {
        "digests": digests.astype("<i8"),
        "offsets": np.concatenate([[0], np.cumsum(sizes)]).astype("<i8"),
        "hosts": hosts.astype("<i4"),
        "blocked": blocked.astype(np.uint8),
        "shapes": shapes.astype("<i4").ravel(),
        "strings": np.frombuffer(b"".join(rules.cast(pa.binary()).to_pylist()), np.uint8),
    }
    listed, at = {}, 0
    for name, array in parts.items():
        listed[name] = (array.dtype.str, len(array), at)
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(listed).encode()
    head += b" " * (-(len(MAGIC) + 4 + len(head)) % 8)
    yield MAGIC + struct.pack("<I", len(head)) + head
    for array in parts.values():
        yield array.tobytes() + b"\0" * (-array.nbytes % 8)


class ListFile:
    """A file of the list, over a buffer that may be mapped memory: nothing is copied out of it."""

    def __init__(self, data: pa.Buffer) -> None:
        view = memoryview(data)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a file of this format")
        (size,) = struct.unpack_from("<I", view, len(MAGIC))
        base = len(MAGIC) + 4 + size
        listed = json.loads(bytes(view[len(MAGIC) + 4 : base]))
        part = {
            name: np.frombuffer(view, dtype, count, base + offset)
            for name, (dtype, count, offset) in listed.items()
        }
        self.digests, self.hosts, self.blocked = part["digests"], part["hosts"], part["blocked"]
        #: Distinct (host bytes, path bytes) of the rules.
        self.shapes = part["shapes"].reshape(-1, 2)
        self.rules = pa.LargeStringArray.from_buffers(
            len(self.digests), pa.py_buffer(part["offsets"]), pa.py_buffer(part["strings"]))

    def find(self, digests: np.ndarray, strings: pa.Array) -> np.ndarray:
        """The place of each string in the list, -1 where it is not: binary search, then the whole string."""
        found = np.full(len(digests), -1, np.int64)
        left = np.searchsorted(self.digests, digests, side="left")
        right = np.searchsorted(self.digests, digests, side="right")
        wanted = strings.cast(pa.large_string())
        step = 0
        open_ = np.flatnonzero(right > left)
        while len(open_):  # more than once only for equal digests of different strings
            at = left[open_] + step
            equal = pc.equal(self.rules.take(pa.array(at)), wanted.take(pa.array(open_)))
            equal = equal.to_numpy(zero_copy_only=False)
            found[open_[equal]] = at[equal]
            step += 1
            open_ = open_[~equal & (left[open_] + step < right[open_])]
        return found


def write_list(rules: DataFrame, folder: str) -> DataFrame:
    """Write a list to folder from rules (host, path, action) and give the table of its files.

    Hosts are lower-cased (A-Z). A rule without host, or whose path does not
    begin with a slash, is an error, as is an action but allow or block; null
    rows (all three null) are skipped. Repeated rules count once; if their
    actions differ, block wins. Files appear under their names when whole, a
    repeated task writes the same bytes, and only files named in folder/files
    are read. Sorting is by Spark's range partitioning, so a list may be of any size.
    """
    spark = prepare(rules.sparkSession)
    clean = rules.filter("NOT (host IS NULL AND path IS NULL AND action IS NULL)").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "action")
    sound = F.coalesce(
        (F.col("host") != "") & ~F.col("host").rlike("[/?#]") & F.col("path").rlike("^/[^?#]*$")
        & F.col("action").isin("allow", "block"), F.lit(False))
    clean = clean.filter(F.when(sound, True).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("not a rule:"), "host", "path", "action")).cast("boolean")))
    whole = F.concat("host", "path")
    once = clean.groupBy(whole.alias("rule"), F.octet_length("host").alias("host_bytes")).agg(
        F.max(F.col("action") == "block").alias("blocked"))
    keyed = once.withColumn("digest", F.xxhash64("rule"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(f"{top}/lists", recursive=True)
        held, count, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            name = f"{TaskContext.get().partitionId():06d}-{number:06d}.urls"
            draft = f"{top}/lists/.{name}.{uuid.uuid4().hex}"
            digests = rows["digest"].to_numpy()
            with store.open_output_stream(draft) as out:
                for piece in _file(digests, rows["rule"].combine_chunks(),
                                   rows["host_bytes"].to_numpy(), rows["blocked"].to_numpy()):
                    out.write(piece)
            store.move(draft, f"{top}/lists/{name}")
            return pa.RecordBatch.from_pylist([{"name": name, "rules": len(digests)}])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= FILE_RULES:
                yield flush()
                held, count, number = [], 0, number + 1
        if count:
            yield flush()

    ordered = keyed.repartitionByRange("digest").sortWithinPartitions("digest", "rule")
    ordered.mapInArrow(run, "name string, rules long").write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


# ---------------------------------------------------------------- judging


def _open(store, path: str) -> ListFile:
    if store.type_name == "local":
        return ListFile(pa.memory_map(path).read_buffer())  # pages of the file, shared by all workers of a host
    with store.open_input_file(path) as file:
        return ListFile(file.read_buffer())


def _candidates(hosts: pa.Array, paths: pa.Array, shapes: np.ndarray) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """For each shape: its number, the rows that could hold a rule of it, and what that rule would be."""
    host_bytes = pc.binary_length(hosts).to_numpy(zero_copy_only=False)
    path_bytes = pc.binary_length(paths).to_numpy(zero_copy_only=False)
    for size in np.unique(shapes[:, 0]):
        long = np.flatnonzero(host_bytes >= size)
        some = hosts.take(pa.array(long))
        dot = pc.equal(pc.binary_slice(some, -int(size) - 1, -int(size)), b".").to_numpy(zero_copy_only=False)
        rows = long[(host_bytes[long] == size) | dot]
        ends = pc.binary_slice(hosts.take(pa.array(rows)), -int(size))
        for k in np.flatnonzero(shapes[:, 0] == size):
            length = int(shapes[k, 1])
            far = path_bytes[rows] >= length
            if far.any():
                starts = pc.binary_slice(paths.take(pa.array(rows[far])), 0, length)
                yield int(k), rows[far], pc.binary_join_element_wise(ends.filter(pa.array(far)), starts, b"")


def judge_batch(hosts: pa.Array, paths: pa.Array, files: Iterator[ListFile]) -> tuple[list, np.ndarray]:
    """Per row the longest rule that fits, or None, and whether it blocks."""
    hosts, paths = hosts.cast(pa.binary()), paths.cast(pa.binary())
    rules: list[str | None] = [None] * len(hosts)
    blocked = np.zeros(len(hosts), bool)
    best = np.zeros((len(hosts), 2), np.int64)  # whole length and host length of the rule so far
    for file in files:
        for k, rows, strings in _candidates(hosts, paths, file.shapes):
            host, path = file.shapes[k].tolist()
            better = (best[rows, 0] < host + path) | ((best[rows, 0] == host + path) & (best[rows, 1] < host))
            rows, strings = rows[better], strings.filter(pa.array(better))
            coded = strings.dictionary_encode()
            names = coded.dictionary
            digests = np.fromiter(
                (xxhash.xxh64_intdigest(s.as_buffer(), seed=SEED) for s in names), np.uint64, len(names)
            ).view(np.int64)
            # Only valid UTF-8 can be a rule; a cut through a character is none.
            texts = pa.array([bytes(s.as_buffer()).decode("utf-8", "replace") for s in names], pa.string())
            places = file.find(digests, texts)
            places[places >= 0] = np.where(file.hosts[places[places >= 0]] == host, places[places >= 0], -1)
            code = coded.indices.to_numpy()
            at = places[code]
            hit = np.flatnonzero(at >= 0)
            block = file.blocked[at[hit]].astype(bool)
            for row, c, b in zip(rows[hit].tolist(), code[hit].tolist(), block.tolist(), strict=True):
                rules[row], blocked[row] = texts[c].as_py(), b
            best[rows[hit]] = (host + path, host)
    return rules, blocked


def judge(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict of every row of pages by the list in folder.

    Host and path are cut from the url as it stands: no decoding, ports and
    user names stay in the host. Of the rules that fit, the longest counts (of
    equally long ones, that with the longer host); a url that no rule fits is
    allowed, with a null rule. A null url, or one without ://, has an empty host
    and path and so fits no rule. Rows are judged each, repeated and null keys
    too; other columns are not read. An empty list allows everything, an empty
    table gives no rows. A url's work grows with the distinct lengths of rules
    that its host and path reach, so a very long one costs little more.
    """
    spark = prepare(pages.sparkSession)
    names = [r["name"] for r in spark.read.parquet(f"{folder}/files").select("name").collect()]  # a row per file
    after = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    rest = F.when(F.instr(F.col(url), "://") > 0, after).otherwise("")
    raw = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(_rest, length(_raw) + 1)"), r"^[^?#]*", 0)
    given = (
        pages.select(F.col(key).alias("_key"), rest.alias("_rest"))
        .withColumn("_raw", raw)
        .select("_key", F.translate("_raw", _UPPER, _LOWER).alias("host"), path.alias("path"))
    )
    kind = dict(given.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for part in large_batches(batches, "path"):
            part = part.combine_chunks()
            hosts, paths = (part[c].combine_chunks() for c in ("host", "path"))
            rules, blocked = judge_batch(hosts, paths, (_open(store, f"{top}/lists/{n}") for n in names))
            yield pa.RecordBatch.from_arrays(
                [part["_key"].combine_chunks(), hosts, paths, pa.array(rules, pa.string()),
                 pa.array(np.where(blocked, "block", "allow").tolist(), pa.string())],
                ["_key", "host", "path", "rule", "verdict"],
            )

    judged = given.mapInArrow(run, f"_key {kind}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("_key", key)


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    listed = new_path(spark, "urls")
    write_list(spark.createDataFrame(RULES, "host string, path string, action string"), listed)
    return judge(table(spark, folder, "pages"), listed)
