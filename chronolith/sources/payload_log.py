"""The log of requests: attempts, invalidations, what may be served and what is to be tried when.

A log is an append-only table (LOG). ``kind`` is ``answer`` or ``invalidate``; an answer has its HTTP status, 0 where there was none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "key string, at timestamp, kind string, status int, text string"

# Statuses that are final and those after which a server wants to be left alone, tries, and seconds of waiting.
FINAL = [400, 401, 404, 405, 410]
BUSY = [403, 429, 500, 502, 503, 504]
TRIES, WAIT, WAIT_BUSY = 3, 1, 5

# Codes and messages of errors that come as successes, and what they are.
ERROR_CODES = {"30": "key not registered", "31": "key expired", "22": "too many requests", "20": "access denied", "12": "no such service", "10": "bad parameters"}
ERROR_MESSAGES = {"SERVICE_KEY_IS_NOT_REGISTERED_ERROR": "30", "NO_OPENAPI_SERVICE_ERROR": "12", "LIMITED_NUMBER_OF_SERVICE_REQUESTS_EXCEEDS_ERROR": "22", "SERVICE_ACCESS_DENIED_ERROR": "20", "DEADLINE_HAS_EXPIRED_ERROR": "31"}


def _table(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def error_class(text: Column) -> Column:
    """What is wrong with an answer that came as a success, or null: a page in place of data, a known code or message, or ``other``."""
    head = F.ltrim(text)
    page = F.startswith(head, F.lit("<!DOCTYPE")) | F.contains(F.lower(F.left(head, F.lit(200))), F.lit("<html"))

    def tag(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, f"<{n}>([^<]*)</{n}>", 1)), F.lit("")) for n in names))

    code, message = tag("returnReasonCode", "resultCode"), tag("errMsg", "returnAuthMsg")
    envelope = F.contains(text, F.lit("OpenAPI_ServiceResponse")) | F.contains(text, F.lit("errMsg"))
    known = F.coalesce(_table(ERROR_CODES, code), _table(ERROR_CODES, _table(ERROR_MESSAGES, message)))
    return F.when(page, "not an API").when(envelope & (code.isNotNull() | message.isNotNull()), F.coalesce(known, F.lit("other")))


def good() -> Column:
    return (F.col("kind") == "answer") & (F.col("status") == 200) & F.col("text").isNotNull() & error_class(F.col("text")).isNull()


def served(log: DataFrame) -> DataFrame:
    """``key, at, text``: of every key the latest good answer, unless it was invalidated since."""
    one = log.groupBy("key").agg(F.max(F.when(F.col("kind") == "invalidate", F.col("at"))).alias("gone"), F.max(F.when(good(), F.struct("at", "text"))).alias("x"))
    return one.where("x is not null and (gone is null or x.at > gone)").select("key", "x.at", "x.text")


def due(log: DataFrame, tries: int = TRIES) -> DataFrame:
    """``key, failures, state, next_at`` of keys without an answer that may be served.

    Attempts count since the last good answer or invalidation. ``open`` keys are tried at ``next_at``, after a time that doubles with
    every failure; ``refused`` ones got a final status or an error of the API, and ``given_up`` ones failed too often: these wait
    for an invalidation.
    """
    since = log.groupBy("key").agg(F.max(F.when((F.col("kind") == "invalidate") | good(), F.col("at"))).alias("since"), F.max("at").alias("seen"))
    failed = log.where((F.col("kind") == "answer") & ~F.coalesce(good(), F.lit(False)))
    after = failed.join(since, "key").where("since is null or at > since")
    last = after.groupBy("key").agg(F.count(F.lit(1)).alias("failures"), F.max(F.struct("at", "status", "text")).alias("x"))
    rows = since.join(served(log).select("key"), "key", "left_anti").join(last, "key", "left")
    final = F.col("x.status").isin(FINAL) | ((F.col("x.status") == 200) & error_class(F.col("x.text")).isNotNull())
    state = F.when(F.col("failures").isNull(), "open").when(final, "refused").when(F.col("failures") >= tries, "given_up").otherwise("open")
    wait = F.when(F.col("x.status").isin(BUSY), WAIT_BUSY).otherwise(WAIT) * F.pow(F.lit(2), F.col("failures") - 1)
    at = F.when(F.col("failures").isNull(), F.col("seen")).otherwise(F.col("x.at") + F.make_dt_interval(secs=wait.cast("decimal(18,6)")))
    return rows.select("key", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), state.alias("state"), F.when(state == "open", at).alias("next_at"))
