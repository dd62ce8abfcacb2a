"""Where deduplication keeps its keys: one interface, in a process or in a stream's state store."""

from __future__ import annotations

from abc import ABC, abstractmethod

from .steps import dedup_step


class DedupBackend(ABC):
    """Live keys of one stream. Times are the rows' own, in microseconds, and never run back."""

    @abstractmethod
    def check_and_register(self, key: str, t_us: int, ttl_us: int) -> bool:
        """Whether the key is novel; a novel one lives until ``t_us + ttl_us``, a repeat doesn't renew it."""

    @abstractmethod
    def expires(self, key: str) -> int | None:
        """When the key's entry expires or has expired; null without one."""

    @abstractmethod
    def evict(self, key: str) -> None:
        """Forget the key, if it is there."""

    @abstractmethod
    def size(self) -> int:
        """Entries, expired ones included until they are purged."""

    @abstractmethod
    def purge_expired(self, now_us: int) -> int:
        """Forget what has expired; how many that were."""


class InProcess(DedupBackend):
    """A dictionary; what a batch fold keeps for its key."""

    def __init__(self):
        self.entries: dict[str, int] = {}

    def check_and_register(self, key, t_us, ttl_us):
        novel, self.entries[key] = dedup_step(self.entries.get(key), t_us, ttl_us)
        return novel

    def expires(self, key):
        return self.entries.get(key)

    def evict(self, key):
        self.entries.pop(key, None)

    def size(self):
        return len(self.entries)

    def purge_expired(self, now_us):
        gone = [k for k, e in self.entries.items() if e <= now_us]
        for k in gone:
            del self.entries[k]
        return len(gone)


class StateBacked(DedupBackend):
    """Map state of a streaming operator: a state row for each key, and one for each millisecond in which keys expire.

    ``seen``: key to expiry; ``due``: millisecond to the keys that were to expire in it. Entries that a micro-batch uses are read
    once and written once, by ``flush``; all others stay as they are in the store.
    """

    SEEN, DUE = ("token string", "expires_us long"), ("ms long", "tokens array<string>")

    def __init__(self, seen, due):
        self.seen, self.due = seen, due
        self.start()

    def start(self) -> None:
        """Begin with another stream's state, or another micro-batch."""
        self._now: dict[str, int | None] = {}
        self._was: dict[str, int | None] = {}

    def expires(self, key):
        if key not in self._now:
            self._now[key] = self._was[key] = self.seen.getValue((key,))[0] if self.seen.containsKey((key,)) else None
        return self._now[key]

    def check_and_register(self, key, t_us, ttl_us):
        novel, self._now[key] = dedup_step(self.expires(key), t_us, ttl_us)
        return novel

    def evict(self, key):
        self.expires(key)
        self._now[key] = None

    def size(self):
        self.flush()
        return sum(1 for _ in self.seen.keys())

    def purge_expired(self, now_us):
        self.flush()
        # the last of these milliseconds may be over in part
        past = sorted(ms for (ms,) in self.due.keys() if (ms - 1) * 1000 < now_us)
        gone = 0
        for ms in past:
            tokens, left = self.due.getValue((ms,))[0], []
            for key in tokens:
                expires = self.seen.getValue((key,))[0] if self.seen.containsKey((key,)) else None
                if expires is not None and expires <= now_us:
                    self.seen.removeKey((key,))
                    gone += 1
                elif expires is not None and -(-expires // 1000) == ms:
                    left.append(key)
            if not left:
                self.due.removeKey((ms,))
            elif len(left) < len(tokens):
                self.due.updateValue((ms,), (left,))
        self.start()
        return gone

    def flush(self) -> list[int]:
        """Write what has changed; the milliseconds in which new entries expire."""
        new: dict[int, list[str]] = {}
        for key, expires in self._now.items():
            if expires == self._was[key]:
                continue
            if expires is None:
                self.seen.removeKey((key,))
            else:
                self.seen.updateValue((key,), (expires,))
                new.setdefault(-(-expires // 1000), []).append(key)
            self._was[key] = expires
        for ms, keys in new.items():
            held = self.due.getValue((ms,))[0] if self.due.containsKey((ms,)) else []
            self.due.updateValue((ms,), (sorted({*held, *keys}),))
        return sorted(new)


class WholeSeconds(DedupBackend):
    """Another backend as an external store with whole seconds keeps times to live: at least one second."""

    def __init__(self, inner: DedupBackend):
        self.inner = inner

    def check_and_register(self, key, t_us, ttl_us):
        return self.inner.check_and_register(key, t_us, max(1, ttl_us // 1_000_000) * 1_000_000)

    def expires(self, key):
        return self.inner.expires(key)

    def evict(self, key):
        self.inner.evict(key)

    def size(self):
        return self.inner.size()

    def purge_expired(self, now_us):
        return self.inner.purge_expired(now_us)
