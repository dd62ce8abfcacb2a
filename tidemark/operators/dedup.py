"""Time-to-live deduplication of ordered streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backends import DedupBackend, InProcess
from .fold import fold, unused
from .steps import dedup_step


def dedup(df: DataFrame, keys: list[str], order: list[str], t_us: Column, ttl_us: Column, evict: Column | None = None) -> DataFrame:
    """``df`` with is_novel and expires_us, per key in order.

    The first row of a key is novel, and later ones once the key has expired; repeats do not renew it. Rows where ``evict``
    holds delete the key; they are not novel and have no expiry. For a key of its own per context, put the context in ``keys``.
    """
    names = [unused(df, n) for n in ("_t", "_ttl", "_evict")]
    x = df.select("*", *[c.alias(n) for n, c in zip(names, (t_us, ttl_us, evict if evict is not None else F.lit(False)))])

    def step(state, t, ttl, gone):
        if gone:
            state[0] = None
            return False, None
        novel, state[0] = dedup_step(state[0], t, ttl)
        return novel, state[0]

    return fold(x, keys, order, names, lambda: [None], step, "is_novel boolean, expires_us long").drop(*names)


def dedup_with(df: DataFrame, keys: list[str], order: list[str], name: str, t_us: str, ttl_us: str, backend: Callable[[], DedupBackend] = InProcess, evict: str | None = None) -> DataFrame:
    """``df`` with is_novel and expires_us, a backend for each stream of ``keys`` and its keys in the column ``name``.

    Expired entries are purged as often as the backend has doubled since, so it holds about what is live. ``evict``: a column
    that is true in rows that delete the key.
    """

    def step(state, key, t, ttl, gone=False):
        store, most = state
        if gone:
            store.evict(key)
            return False, None
        novel = store.check_and_register(key, t, ttl)
        if store.size() > most:
            store.purge_expired(t)
            state[1] = max(1024, 2 * store.size())
        return novel, store.expires(key)

    return fold(df, keys, order, [name, t_us, ttl_us, *([evict] if evict else [])], lambda: [backend(), 1024], step, "is_novel boolean, expires_us long")


def whole_seconds(ttl_ms: Column) -> Column:
    """A time to live as an external store keeps it: whole seconds, at least one; in microseconds."""
    return F.greatest(F.lit(1), F.floor(ttl_ms / 1000)).cast("long") * 1_000_000


def live_entries(deduped: DataFrame, keys: list[str], order: list[str], now_us: Column) -> DataFrame:
    """The keys whose last entry has not expired at ``now_us``."""
    last = deduped.groupBy(*keys).agg(F.max_by("expires_us", F.struct(*order)).alias("expires_us"))
    return last.where(F.col("expires_us") > now_us)
