"""Import of month archives (tar.gz of month/day/file members) into the cold tier."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = re.compile(r"^(20\d{2}-\d{2})/(20\d{2}-\d{2}-\d{2})/([\w.\-]+)$")
SECRET_NAME = re.compile(r"(?i)(?:^|[._-])(?:secret|token|credential|password|passwd|apikey|api[_-]key|auth)(?:[._-]|$)|\.(?:pem|key|p12|pfx|keystore)$|^\.?env(?:\.|$)|^id_(?:rsa|dsa|ecdsa|ed25519)")
SCHEMA = "archive string, month string, day date, file string, line_no long, raw string, problem string"
BATCH = 2000


def safe_name(name: str) -> bool:
    return not name.startswith(".") and not SECRET_NAME.search(name)


def servable(name: Column) -> Column:
    """``safe_name`` as an expression."""
    return ~name.startswith(".") & ~name.rlike(SECRET_NAME.pattern)


def members(content: bytes, limit: int) -> Iterator[tuple]:
    """(month, day, file, line_no, raw, problem) of an archive, one member at a time."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as tar:
            for m in tar:
                found = MEMBER.match(m.name)
                if m.isdir():
                    continue
                if not m.isfile() or not found or not m.name.split("/")[1].startswith(found.group(1)):
                    yield None, None, m.name, None, None, "unsafe member"
                elif not safe_name(found.group(3)):
                    yield None, None, m.name, None, None, "secret name"
                elif m.size > limit:
                    yield None, None, m.name, None, None, "too large"
                else:
                    for number, line in enumerate(tar.extractfile(m), 1):
                        yield found.group(1), pd.Timestamp(found.group(2)).date(), found.group(3), number, line.decode("utf-8", "replace").rstrip("\r\n"), None
    except (tarfile.TarError, OSError, EOFError) as e:
        yield None, None, None, None, None, f"unreadable archive: {type(e).__name__}"


def read_archives(spark: SparkSession, path: str, member_limit: int = 64 << 20) -> DataFrame:
    """Lines of month archives, one archive to a task; unsafe, secret-looking, oversized and unreadable members are rows with ``problem``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                rows: list[tuple] = []
                for row in members(content, member_limit):
                    rows.append((archive, *row))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def good_months(lines: DataFrame) -> DataFrame:
    """Lines of archives without an unreadable part: a corrupt month serves nothing."""
    broken = lines.where(F.col("problem").startswith("unreadable")).select("archive").distinct()
    return lines.where("problem is null").join(broken, "archive", "left_anti").drop("problem")
