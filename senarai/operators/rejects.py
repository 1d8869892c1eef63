"""Loading delimited records and separating those that can't be loaded, each with its reason.

Workers hand every batch of records to DuckDB's CSV reader with reject tables. Each record is written with its number as
a first field, so a rejected line names its record, whatever line breaks its quoted fields hold, and with a last field,
as the reader would overlook an empty field too many at the end of a line. One open quote would
make the reader swallow the records after it; therefore the quoting of each record is checked first, by one regular
expression, and only well-quoted records go to the reader, whose reject table tells wrong field counts and failing casts
of the typed columns. The allowed values are checked in the same SQL statement. What the reader's casts allow beyond a
plain decimal number (`inf`, `1_0`), or refuse of one, is settled by the record itself. A record that comes back neither
loaded nor rejected is an error of the program and raises.

The reader takes files only, so the well-quoted records of a batch lie for the time of its reading in a temporary folder
of the worker; nothing else refers to it, and a lost executor's batch is simply read again.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTIMENTS = ("positif", "negatif", "netral")
LOADED = "line_id bigint, ulasan string, sentiment string, confidence double, reason string"

#: field(,field)* with a field quoted only if its first character is a quote, quotes inside doubled.
_WELL_QUOTED = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', re.S)
_FIELD = re.compile(r'"(?:[^"]|"")*"|[^",]+', re.S)
_PLAIN_NUMBER = re.compile(r'(?s).*,("?)[ \t]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[ \t]*\1')
#: Characters of one file for the reader, so that its memory has a bound however large a batch of records is.
FILE_CHARS = 8_000_000
_MAX_LINE = 1 << 30


def well_quoted(record: str) -> bool:
    return _WELL_QUOTED.fullmatch(record) is not None


def _one_line_fields(record: str) -> str:
    """Unquoted fields with line breaks in quotes, so that the reader takes the record as one."""
    outside = _FIELD.sub(lambda m: "" if m[0][0] == '"' else m[0], record)
    if "\n" not in outside and "\r" not in outside:
        return record
    return _FIELD.sub(lambda m: m[0] if m[0][0] == '"' or not re.search(r"[\r\n]", m[0]) else f'"{m[0]}"', record)


def read_records(records: Sequence[str], sentiments: Sequence[str] = SENTIMENTS) -> dict[int, tuple]:
    """Number of the record -> (ulasan, sentiment, confidence, reason) of well-quoted records."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "records.csv")
        with open(path, "w", encoding="utf-8", errors="surrogatepass", newline="") as out:
            for i, record in enumerate(records):
                out.write(f"{i},{_one_line_fields(record)},.\n")
        longest = max((len(r.encode("utf-8", "surrogatepass")) for r in records), default=0) + 64
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": folder})
        try:
            loaded = con.execute(
                f"""
                SELECT i, ulasan, sentiment, confidence,
                       CASE WHEN regexp_full_match(ulasan, '[\\s\\p{{Z}}]*') OR sentiment NOT IN ({", ".join("?" for _ in sentiments)})
                              OR NOT coalesce(confidence BETWEEN -1 AND 1, false) THEN 'value' END AS reason
                FROM read_csv(?, header = false, auto_detect = false, delim = ',', quote = '"', escape = '"', new_line = '\\n',
                              columns = {{'i': 'BIGINT', 'ulasan': 'VARCHAR', 'sentiment': 'VARCHAR', 'confidence': 'DOUBLE', 'last': 'VARCHAR'}},
                              store_rejects = true, rejects_limit = 0, max_line_size = {min(_MAX_LINE, max(2_000_000, 2 * longest))},
                              force_not_null = ['ulasan', 'sentiment'], strict_mode = true, parallel = false)
                """,
                [*sentiments, path],
            ).fetchall()
            rejected = con.execute("SELECT csv_line, error_type FROM reject_errors").fetchall()
        finally:
            con.close()
    result: dict[int, tuple] = {}
    for i, u, s, c, reason in loaded:
        value = reason is not None or not _PLAIN_NUMBER.fullmatch(records[i])
        result[i] = (None, None, None, "value") if value else (u, s, c, None)
    for line, kind in rejected:
        if not (number := re.match(r"\d+", line or "")):
            continue
        i = int(number[0])
        if "CAST" not in str(kind).upper():
            result[i] = (None, None, None, "columns")
        elif result.get(i, (None,) * 4)[3] != "columns":
            result[i] = _refused_cast(records[i], sentiments)
    if len(result) != len(records):
        raise RuntimeError(f"{len(records) - len(result)} records came back neither loaded nor rejected")
    return result


def _refused_cast(record: str, sentiments: Sequence[str]) -> tuple:
    """The fields of a well-quoted record whose cast failed: loaded after all if its number is a plain decimal one."""
    number = _PLAIN_NUMBER.fullmatch(record)
    fields = [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in _split(record)]
    if number and len(fields) == 3 and not re.fullmatch(r"\s*", fields[0]) and fields[1] in sentiments and -1 <= float(number[2]) <= 1:
        return fields[0], fields[1], float(number[2]), None
    return None, None, None, "value" if len(fields) == 3 else "columns"


def _split(record: str) -> list[str]:
    """The raw fields of a well-quoted record."""
    return [m[0].removeprefix(",") for m in re.finditer(r'(?:^|,)(?:"(?:[^"]|"")*"|[^",]*)', record)]


def classify_lines(lines: DataFrame, key: str, line: str, sentiments: Sequence[str] = SENTIMENTS) -> DataFrame:
    """line_id, ulasan, sentiment, confidence, reason for every record: the typed fields of a valid one (reason null),
    else the first reason that holds, of quoting, columns and value.

    A null record gives no row. The empty record has one field, so its reason is columns. Repeated records are classified
    each. Records are read where they lie, in batches of bounded size: there is no shuffle, and a file that holds a third
    of all records is spread over tasks. An empty table gives no rows; columns other than the two are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = [(None, None, None, "quoting")] * len(ids)
            files: list[list[int]] = [[]]
            size = 0
            for i, t in enumerate(texts):
                if well_quoted(t):
                    if size > FILE_CHARS:
                        files.append([])
                        size = 0
                    files[-1].append(i)
                    size += len(t)
            for part in files:
                read = read_records([texts[i] for i in part], sentiments) if part else {}
                for k, i in enumerate(part):
                    rows[i] = read[k]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["line_id", "ulasan", "sentiment", "confidence", "reason"],
            )

    rows = lines.where(F.col(line).isNotNull()).select(F.col(key).cast("bigint").alias("line_id"), F.col(line).alias("line"))
    return rows.mapInArrow(run, LOADED)


def rejected_lines(lines: DataFrame, key: str, line: str) -> DataFrame:
    """line_id, reason of the records that can't be loaded."""
    return classify_lines(lines, key, line).where("reason IS NOT NULL").select("line_id", "reason")


def loaded_rows(lines: DataFrame, key: str, line: str) -> DataFrame:
    """line_id, ulasan, sentiment, confidence of the valid records."""
    return classify_lines(lines, key, line).where("reason IS NULL").drop("reason")


def reject_report(lines: DataFrame, key: str, line: str, file: str) -> DataFrame:
    """file, reason ('loaded' for valid records), n: counts for each file."""
    reasons = classify_lines(lines, key, line).select("line_id", F.coalesce("reason", F.lit("loaded")).alias("reason"))
    named = lines.select(F.col(key).cast("bigint").alias("line_id"), F.col(file).alias("file_id"))
    return named.join(reasons, "line_id").groupBy("file_id", "reason").agg(F.count(F.lit(1)).alias("n"))
