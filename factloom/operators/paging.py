"""Keyset pages, opaque cursors and change-feed reads."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_LIMIT = 100


def after(observed: str, id_col: str, cursor: tuple[Column, Column] | None) -> Column:
    """Rows behind a cursor in the order (observed desc, id asc)."""
    if cursor is None:
        return F.lit(True)
    at, last = cursor
    return (F.col(observed) < at) | ((F.col(observed) == at) & (F.col(id_col) > last))


def keyset_page(df: DataFrame, observed: str, id_col: str, limit: int, cursor: tuple[Column, Column] | None = None) -> DataFrame:
    """``limit`` + 1 rows of the page behind the cursor; the extra row tells that more follow."""
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be between 1 and {PAGE_LIMIT}")
    return df.where(after(observed, id_col, cursor)).orderBy(F.col(observed).desc(), F.col(id_col).asc()).limit(limit + 1)


def cursor_exists(df: DataFrame, observed: str, id_col: str, cursor: tuple[Column, Column]) -> bool:
    """Whether the cursor's row is in the same filtered snapshot."""
    return not df.where((F.col(observed) == cursor[0]) & (F.col(id_col) == cursor[1])).limit(1).isEmpty()


def feed_after(df: DataFrame, sequence: str, cursor: int, limit: int) -> DataFrame:
    """``limit`` + 1 rows of a change feed behind a sequence number, oldest first."""
    return df.where(F.col(sequence) > cursor).orderBy(sequence).limit(limit + 1)


def encode_cursor(observed: datetime, row_id: str) -> str:
    if observed.tzinfo is None:
        raise ValueError("a cursor needs a timezone-aware instant")
    raw = json.dumps([observed.isoformat(), row_id], separators=(",", ":"), ensure_ascii=False).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def decode_cursor(text: str) -> tuple[datetime, str]:
    """The cursor's instant and id; anything but the canonical form is an error."""
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        observed, row_id = json.loads(raw)
        found = datetime.fromisoformat(observed), str(row_id)
    except (ValueError, TypeError) as error:
        raise ValueError("invalid cursor") from error
    if encode_cursor(*found) != text:
        raise ValueError("invalid cursor")
    return found
