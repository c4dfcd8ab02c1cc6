"""URL filter: a sorted digest array, memory-mapped by every task, with confirmed matches.

Rules are entries ``host + path`` with a verdict.  Their 64-bit xxhash keys are written, sorted, to one file with
the entries' strings behind them; Spark hands the file to every executor once and each task maps it into memory,
so the pages are shared by all tasks of a machine and nothing is held per task.  A url asks for every suffix of
its host of no more labels than some rule's host, with every prefix of its path that is as long as some rule's path;
all questions of a batch are hashed and searched in the array at once, and each hit is confirmed on the stored string, so a hash collision never
decides.  Of the rules that fit, the longest one (host and path together) wins.

Results for odd input: a null url, and one without ``://``, has an empty host and path and fits no rule; a null
``page_id`` is judged like any other; repeated rows are judged one by one; a url that no rule fits gets
``default``; other columns are left alone; an empty table gives an empty result, an empty rule list fits nothing.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch

#: (host, path, verdict)
Rule = tuple[str, str, str]
HEAD = 4


class DigestArray:
    """Sorted 64-bit keys with their strings and numbers, in one file.

    Layout, little-endian 64-bit: number of entries, bytes of strings, two spare; keys; ends of the strings in
    the order of the keys; values; then the strings in UTF-8.
    """

    def __init__(self, path: str):
        head = np.memmap(path, "<u8", "r", shape=(HEAD,))
        n = int(head[0])
        table = np.memmap(path, "<u8", "r", offset=8 * HEAD, shape=(3, n)) if n else np.zeros((3, 0), "<u8")
        self.keys, self.ends, self.values = table
        self.text = np.memmap(path, np.uint8, "r", offset=8 * (HEAD + 3 * n), shape=(int(head[1]),)) if head[1] else np.zeros(0, np.uint8)

    @staticmethod
    def write(path: str, entries: dict[str, int]) -> None:
        """Write distinct strings, each with a number."""
        data = [x.encode("utf-8", "surrogatepass") for x in entries]
        keys = np.array([xxhash.xxh64_intdigest(x) for x in data], "<u8")
        order = np.argsort(keys, kind="stable")
        ends = np.cumsum([len(data[k]) for k in order], dtype=np.int64).astype("<u8") if data else np.zeros(0, "<u8")
        values = np.array(list(entries.values()), "<u8")[order] if data else np.zeros(0, "<u8")
        with open(path, "wb") as out:
            out.write(np.array([len(data), sum(map(len, data)), 0, 0], "<u8").tobytes())
            out.write(keys[order].tobytes() + ends.tobytes() + values.tobytes() + b"".join(data[k] for k in order))

    def find(self, asked: list[bytes]) -> np.ndarray:
        """The number of each string, -1 for those not in the array."""
        digests = np.array([xxhash.xxh64_intdigest(x) for x in asked], "<u8")
        first = np.searchsorted(self.keys, digests, "left")
        last = np.searchsorted(self.keys, digests, "right")
        out = np.full(len(asked), -1, np.int64)
        for k in np.flatnonzero(last > first):  # only hits: all entries of one key are compared
            for at in range(first[k], last[k]):
                begin = int(self.ends[at - 1]) if at else 0
                if self.text[begin : int(self.ends[at])].tobytes() == asked[k]:
                    out[k] = self.values[at]
        return out


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), slash + path


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict``, a row for each row of ``pages (page_id, url)``.

    Two rules of one host and path must agree; a host and path are told apart by the first ``/`` of their text, so
    a rule's path is empty or begins with one.
    """
    listed: dict[str, int] = {}
    verdicts: list[str] = []
    for host, path, verdict in rules:
        text = host + path
        if "/" in host or (path and not path.startswith("/")):
            raise ValueError(f"rule {text!r}: the path begins with the first slash")
        if listed.setdefault(text, len(verdicts)) < len(verdicts):
            if verdicts[listed[text]] != verdict:
                raise ValueError(f"rule {text!r} has two verdicts")
            continue
        verdicts.append(verdict)
    lengths = sorted({len(path) for _, path, _ in rules})
    depth = max((host.count(".") + 1 for host, _, _ in rules), default=0)
    folder = Path(tempfile.mkdtemp(prefix="digests"))
    file = folder / f"{folder.name}.bin"
    DigestArray.write(str(file), listed)
    pages.sparkSession.sparkContext.addFile(str(file))
    name = file.name

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        array = DigestArray(SparkFiles.get(name))
        hosts, paths, asked, owners = [], [], [], []
        for k, url in enumerate(batch.column("url").to_pylist()):
            host, path = parts(url)
            hosts.append(host)
            paths.append(path)
            labels = host.rsplit(".", depth)
            suffixes = [".".join(labels[a:]) for a in range(max(0, len(labels) - depth), len(labels))]
            for suffix in suffixes:
                for length in lengths:
                    if length <= len(path):
                        asked.append((suffix + path[:length]).encode("utf-8", "surrogatepass"))
                        owners.append(k)
        best: list[str | None] = [None] * len(hosts)
        verdict = [default] * len(hosts)
        found = array.find(asked)
        for at in np.flatnonzero(found >= 0):
            k, text = owners[at], asked[at].decode("utf-8", "surrogatepass")
            if best[k] is None or len(text) > len(best[k]):
                best[k], verdict[k] = text, verdicts[found[at]]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(best, pa.string()), pa.array(verdict, pa.string())],
            ["page_id", "host", "path", "rule", "verdict"],
        )

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return by_batch(plain, work, "page_id long, host string, path string, rule string, verdict string")
