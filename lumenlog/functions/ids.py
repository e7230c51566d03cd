"""Identity: canonical content hashes, shard paths and timestamps of mixed kinds."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: keys of a payload that make its identity.
CONTENT_KEYS = ("content", "text", "thinking", "output", "error", "content_blocks", "input", "data", "files", "summarizes", "model")


@F.pandas_udf(StringType())
def content_hash(payload: pd.Series) -> pd.Series:
    """First 16 hexadecimal digits of the SHA-256 of a payload's content keys as JSON with sorted keys; null if it isn't an object."""

    def one(text):
        try:
            whole = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not isinstance(whole, dict):
            return None
        kept = {k: v for k, v in whole.items() if k in CONTENT_KEYS}
        return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False).encode("utf-8", "replace")).hexdigest()[:16]

    return payload.map(one)


def dedup_key(message_id: Column, event_type: Column, part: Column, digest: Column) -> Column:
    """{message id, or c=hash}:{event type}:{part}:{hash}."""
    return F.concat_ws(":", F.coalesce(message_id, F.concat(F.lit("c="), digest)), event_type, F.coalesce(part, F.lit("")), digest)


def key_part(tool_call_id: Column, block_index: Column) -> Column:
    """What tells events of one message apart: the tool's call, or the block's place."""
    return F.coalesce(F.concat(F.lit("tool="), F.nullif(tool_call_id, F.lit(""))), F.concat(F.lit("blk="), block_index.cast("string")), F.lit(""))


def shard(thread_id: Column, depth: int) -> Column:
    """Folder of a thread: `depth` levels, each a byte of the SHA-256 of its id."""
    digest = F.sha2(thread_id.cast("string").cast("binary"), 256)
    return F.concat_ws("/", *[F.substring(digest, 1 + 2 * i, 2) for i in range(depth)]) if depth else F.lit("")


def shard_depth(threads: int, per_folder: int = 1024) -> int:
    """Least depth at which folders hold at most `per_folder` threads on average."""
    depth = 0
    while -(-threads // 256**depth) > per_folder:
        depth += 1
    return depth


#: What counts as an ISO time: a date, and perhaps a time of day with an offset; basic dates (yyyymmdd) are spread first.
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
#: First and last second of the years 1 to 9999.
_FIRST_SECOND, _LAST_SECOND = -62_135_596_800, 253_402_300_799


def parsed_timestamp(text: Column) -> Column:
    """An ISO date or time as a timestamp, without an offset in UTC; null for any other text, numbers included."""
    spread = F.regexp_replace(F.trim(text), "^([0-9]{4})([0-9]{2})([0-9]{2})(?=$|T)", "$1-$2-$3")
    return F.when(spread.rlike(_ISO), F.try_to_timestamp(spread))


def epoch_timestamp(number: Column) -> Column:
    """Seconds since 1970, or milliseconds if above 1e12, as a timestamp; null for what is no time of the years 1 to 9999."""
    seconds = F.when(number > 1_000_000_000_000, number / 1000).otherwise(number.cast("double"))
    # NaN is greater than any number, so it is out of range too.
    return F.when(seconds.between(_FIRST_SECOND, _LAST_SECOND), F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")))
