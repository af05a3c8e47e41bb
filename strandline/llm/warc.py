"""WARC records, and not-modified revisits resolved to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship

#: Headers that a 304 response may update. Fixed values, by the HTTP specification.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't name a resource: names, and one prefix.
TRACKING = ("ref", "fbclid", "gclid")
#: Seconds of a bucket: a task of the as-of join holds one bucket of a URL.
BUCKET = 86_400
RECORD = "record_id string, type string, url string, ts bigint, status int, headers map<string,string>, body binary, error string"


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment, tracking parameters or a trailing slash; host in lower case, parameters sorted; null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, url_key, ts, response_id, verdict, status, headers) for every not-modified revisit of records.

    records: (record_id, type 'response' or 'revisit', url, ts in seconds, status, headers with lower-case names). A revisit
    is a record of type revisit. Its response is the latest full one (type response, status 200 to 299) of the same canonical
    URL that is strictly earlier; among equal times the greatest record_id. The verdict says whether validators agree:
    'match' if the revisit's entity tag (compared weakly) or, without one, its Last-Modified is the response's; 'unchecked' if
    it has neither; 'mismatch', or 'orphan' without an earlier response. For match and unchecked, status is the response's and
    headers are its own, updated by those of the revisit that a 304 may send; else null.

    The as-of join has two levels: a running maximum within a bucket of time of a URL, and the buckets' latest responses,
    pre-aggregated, carried on to later buckets; so a URL with a third of all captures is spread over its buckets. Only ids
    and times are carried; headers are joined last. Records with a null url or time are never matched, and meet no other row:
    such revisits are orphans. Extra columns are ignored. Repeated rows stay repeated; of responses with the same id, the greatest by time and status counts.
    """
    rows = records.select(F.col("record_id").cast("string").alias("record_id"), "type", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("bigint").alias("ts"), F.col("status").cast("int").alias("status"), "headers")
    rows = rows.withColumn("bucket", F.floor(F.col("ts") / BUCKET))
    orphans = rows.where("type = 'revisit' and (url_key is null or ts is null)")
    rows = rows.where("url_key is not null and ts is not null")
    full = (F.col("type") == "response") & F.col("status").between(200, 299)
    mark = F.when(full, F.struct("ts", "record_id"))
    level = rows.select("record_id", "type", "url_key", "ts", "bucket", mark.alias("mark"), F.when(F.col("type") == "revisit", F.col("headers")).alias("headers"))
    within = Window.partitionBy("url_key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("near", F.max("mark").over(within)).where("type = 'revisit'")
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("url_key", "bucket").agg(F.max(mark).alias("last")).select(F.col("url_key").alias("_u"), F.col("bucket").alias("_b"), F.max("last").over(before).alias("far"))
    level = level.join(buckets, (F.col("url_key") == F.col("_u")) & (F.col("bucket") == F.col("_b")), "left")
    level = level.withColumn("found", F.coalesce("near", "far"))
    response = rows.where(full).groupBy(F.col("record_id").alias("_r"), F.col("url_key").alias("_ru"), F.col("ts").alias("_rt")).agg(F.max("status").alias("r_status"), F.max_by("headers", "status").alias("r_headers"))
    out = level.join(response, (F.col("found.record_id") == F.col("_r")) & (F.col("found.ts") == F.col("_rt")) & (F.col("url_key") == F.col("_ru")), "left")
    empty = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce("headers", empty), F.coalesce("r_headers", empty)
    tag = lambda m: F.regexp_replace(F.try_element_at(m, F.lit("etag")), "^W/", "")
    modified = lambda m: F.try_element_at(m, F.lit("last-modified"))
    verdict = (
        F.when(F.col("_r").isNull(), "orphan")
        .when(tag(mine).isNotNull(), F.when(tag(mine).eqNullSafe(tag(theirs)), "match").otherwise("mismatch"))
        .when(modified(mine).isNotNull(), F.when(modified(mine).eqNullSafe(modified(theirs)), "match").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    update = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    ok = F.col("verdict").isin("match", "unchecked")
    out = out.withColumn("verdict", verdict).select("record_id", "url_key", "ts", F.col("_r").alias("response_id"), "verdict", F.when(ok, F.col("r_status")).alias("status"), F.when(ok, merged).alias("headers"))
    nothing = lambda kind: F.lit(None).cast(kind)
    return out.union(orphans.select("record_id", "url_key", "ts", nothing("string"), F.lit("orphan"), nothing("int"), nothing("map<string,string>")))


#: Bytes that are unpacked at once.
PIECE = 1 << 20


def unpacked(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, plain or gzip of any number of members, piece by piece. What comes before damage is given; then BrokenGzip is raised."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield data[at : at + PIECE]
        return
    at, rest = 0, memoryview(data)
    while at < len(rest):
        member = zlib.decompressobj(wbits=31)
        try:
            while not member.eof:
                piece = rest[at : at + PIECE]
                if not len(piece):
                    raise BrokenGzip("gzip: cut short")
                out = member.decompress(piece)
                at += len(piece) - len(member.unused_data)
                if out:
                    yield out
        except zlib.error as e:
            raise BrokenGzip(f"gzip: {e}") from None
        while at < len(rest) and rest[at] == 0:  # padding
            at += 1


class BrokenGzip(ValueError):
    pass


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzip, whole or a member a record. A broken record ends the file, with `error`; those before it are kept.

    No more is held unpacked than a record and a piece.
    """
    pieces, held, at, total, broken = unpacked(data), bytearray(), 0, 0, None

    def more() -> bool:
        nonlocal broken
        try:
            held.extend(next(pieces))
        except StopIteration:
            return False
        except BrokenGzip as e:
            broken = str(e)
            return False
        return True

    while True:
        if at:
            total += at
            del held[:at]
            at = 0
        while True:
            while held[at : at + 2] == b"\r\n":
                at += 2
            if len(held) > at + 1 or not more():
                break
        if at >= len(held):
            if broken:
                yield {"record_id": None, "error": broken}
            return
        seen = at
        while (head := held.find(b"\r\n\r\n", seen)) < 0 and held.startswith(b"WARC/"[: len(held) - at], at):
            seen = max(at, len(held) - 3)
            if not more():
                break
        if head < 0 or not held.startswith(b"WARC/", at):
            yield {"record_id": None, "error": broken or f"no record at byte {total + at}"}
            return
        fields = _headers(bytes(held[at:head]).split(b"\r\n")[1:])
        try:
            size = int(fields.get("content-length", ""))
        except ValueError:
            yield {"record_id": fields.get("warc-record-id"), "error": "no length"}
            return
        while len(held) < head + 4 + size and more():
            pass
        block = bytes(held[head + 4 : head + 4 + size])
        at = head + 4 + size
        out = {"record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "ts": _seconds(fields.get("warc-date")), "status": None, "headers": None, "body": block, "error": None if len(block) == size else broken or "cut short"}
        if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
            lines = block[:end].split(b"\r\n")
            code = lines[0].split(b" ")[1:2]
            out |= {"status": int(code[0]) if code and code[0].isdigit() else None, "headers": _headers(lines[1:]), "body": block[end + 4 :]}
        yield out
        if len(block) < size:
            return


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Names in lower case; of repeated ones, values joined by a comma."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def _seconds(date: str | None) -> int | None:
    from datetime import UTC, datetime

    try:
        return int(datetime.fromisoformat(date.replace("Z", "+00:00")).replace(tzinfo=UTC).timestamp()) if date else None
    except ValueError:
        return None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under path; broken ones have `error`. A task holds one file, packed, and a record of it at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("ts", pa.int64()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for record in parse(data.as_py()):
                    rows.append(record | {"headers": list((record.get("headers") or {}).items())})
                    size += len(record.get("body") or b"")
                    if size > 1 << 24 or len(rows) >= 1024:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ship(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log of the table pages, for the query: each page's full response and, later, two revisits, some before it or changed.

    Times, tags and variants of the URL follow from page_id. A null page_id gives null ids and times.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), (p % 900).cast("string"))
    base = F.lit(1_700_000_000) + p * 977 % 31_536_000
    first = F.map_from_arrays(F.array(*map(F.lit, ("content-type", "content-length", "etag", "last-modified", "cache-control"))), F.array(F.lit("text/html"), F.length(F.coalesce("html", F.lit(""))).cast("string"), tag, modified, F.lit("max-age=60")))
    second_tag = F.map_from_arrays(F.array(*map(F.lit, ("etag", "date", "content-length"))), F.array(F.when(p % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag)), F.concat(F.lit("t"), p.cast("string")), F.lit("0")))
    third = F.when(p % 3 == 0, F.map_from_arrays(F.array(F.lit("expires")), F.array(F.lit("never")))).otherwise(F.map_from_arrays(F.array(F.lit("last-modified"), F.lit("vary")), F.array(modified, F.lit("accept"))))
    kinds = F.array(
        F.struct(F.lit("r").alias("k"), F.lit("response").alias("type"), F.col("url").alias("url"), base.alias("ts"), F.when(p % 11 == 0, 404).otherwise(200).alias("status"), first.alias("headers")),
        F.struct(F.lit("a").alias("k"), F.lit("revisit").alias("type"), F.concat("url", F.lit("#seen")).alias("url"), (base + F.when(p % 7 == 0, -60).otherwise(p % 13 * 40_000)).alias("ts"), F.lit(304).alias("status"), second_tag.alias("headers")),
        F.struct(F.lit("b").alias("k"), F.lit("revisit").alias("type"), F.regexp_replace("url", "^https?://", "HTTP://WWW.").alias("url"), (base + 3_000_000).alias("ts"), F.lit(304).alias("status"), third.alias("headers")),
    )
    return pages.select("page_id", F.explode(kinds).alias("x")).select(F.concat(F.col("page_id").cast("string"), F.col("x.k")).alias("record_id"), "x.type", "x.url", "x.ts", "x.status", "x.headers")


def oracle_sql() -> str:
    """DuckDB SQL for the query: the same crawl log, resolved by a plain as-of join."""
    def canon(u):
        bare = f"regexp_replace(regexp_replace(trim({u}), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
        host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '')"
        params = f"list_sort(list_filter(string_split(regexp_extract({bare}, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND regexp_extract(p, '^([^=]*)', 1) NOT IN ('ref', 'fbclid', 'gclid')))"
        return f"{host} || regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END"

    return f"""
WITH p AS (SELECT page_id AS p, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id % 900) AS modified, length(coalesce(html, '')) AS n, 1700000000 + page_id * 977 % 31536000 AS base FROM pages),
r AS (SELECT p || 'r' AS id, p, {canon('url')} AS k, base AS ts, tag, modified, n FROM p WHERE p % 11 <> 0),
v AS (SELECT p || 'a' AS record_id, p, 'a' AS kind, {canon("url || '#seen'")} AS url_key, base + CASE WHEN p % 7 = 0 THEN -60 ELSE p % 13 * 40000 END AS ts, CASE WHEN p % 5 = 0 THEN '"changed"' ELSE tag END AS tag, NULL AS modified FROM p
UNION ALL SELECT p || 'b', p, 'b', {canon("regexp_replace(url, '^https?://', 'HTTP://WWW.')")}, base + 3000000, NULL, CASE WHEN p % 3 <> 0 THEN modified END FROM p),
j AS (SELECT v.*, r.id AS rid, r.tag AS rtag, r.modified AS rmod, r.n AS rn, row_number() OVER (PARTITION BY record_id ORDER BY r.ts DESC NULLS LAST, r.id DESC) AS o FROM v LEFT JOIN r ON v.url_key = r.k AND r.ts < v.ts),
w AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN tag IS NOT NULL THEN CASE WHEN tag = rtag THEN 'match' ELSE 'mismatch' END WHEN modified IS NOT NULL THEN CASE WHEN modified = rmod THEN 'match' ELSE 'mismatch' END ELSE 'unchecked' END AS verdict FROM j WHERE o = 1)
SELECT record_id, url_key, ts, rid AS response_id, verdict, CASE WHEN verdict IN ('match', 'unchecked') THEN 200 END AS status,
CASE WHEN verdict IN ('match', 'unchecked') THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || rn, 'content-type: text/html', CASE WHEN kind = 'a' THEN 'date: t' || p END, 'etag: ' || CASE WHEN kind = 'a' THEN 'W/' || tag ELSE rtag END, CASE WHEN kind = 'b' AND p % 3 = 0 THEN 'expires: never' END, 'last-modified: ' || rmod, CASE WHEN kind = 'b' AND p % 3 <> 0 THEN 'vary: accept' END) END AS headers FROM w"""
