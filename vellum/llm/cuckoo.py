"""A cuckoo filter over digests that keeps, beside each fingerprint, the key it stands for."""

from __future__ import annotations

from array import array

_SLOTS = 4
_KICKS = 200


class CuckooIndex:
    """Digest -> value, with insertion, deletion and growth.

    Buckets of four 16-bit fingerprints answer most misses without touching a key. A
    fingerprint that matches is only a hit once the digest stored for that slot is equal, so
    there are no false positives. When an insertion finds no place after `_KICKS` moves, the
    table doubles and is filled again from the stored keys; a table that is less than half full
    holds too many equal fingerprints for that to help, and the key goes to a plain overflow.
    """

    def __init__(self, capacity: int = 1024):
        self._size(max(2, capacity // 2))

    def _size(self, buckets: int) -> None:
        self.mask = (1 << (buckets - 1).bit_length()) - 1
        self.prints = array("H", bytes(2 * _SLOTS * (self.mask + 1)))
        self.held: list = [None] * (_SLOTS * (self.mask + 1))
        self.overflow: dict = {}
        self.live = 0
        self.turn = 0

    def __len__(self) -> int:
        return self.live

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, one, two = self._places(digest)
        prints, held = self.prints, self.held
        for bucket in (one, two):
            for slot in range(bucket * _SLOTS, bucket * _SLOTS + _SLOTS):
                if prints[slot] == mark and held[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes):
        """The value of a live digest, else None."""
        slot = self._slot(digest)
        return self.overflow.get(digest) if slot < 0 else self.held[slot][1]

    def put(self, digest: bytes, value) -> bool:
        """Set a digest's value; True if it was not live before."""
        slot = self._slot(digest)
        if slot >= 0:
            self.held[slot] = (digest, value)
            return False
        if digest in self.overflow:
            self.overflow[digest] = value
            return False
        self._insert(digest, value)
        return True

    def remove(self, digest: bytes) -> bool:
        """Delete a digest; False if it was not live."""
        slot = self._slot(digest)
        if slot < 0:
            self.live -= digest in self.overflow
            return self.overflow.pop(digest, None) is not None
        self.prints[slot], self.held[slot] = 0, None
        self.live -= 1
        return True

    def items(self):
        yield from (x for x in self.held if x is not None)
        yield from self.overflow.items()

    def _insert(self, digest: bytes, value) -> None:
        entry = (digest, value)
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            if self._settle(bucket, mark, entry):
                return
        bucket = two
        for _ in range(_KICKS):
            self.turn = (self.turn + 1) % _SLOTS
            slot = bucket * _SLOTS + self.turn
            mark, self.prints[slot] = self.prints[slot], mark
            entry, self.held[slot] = self.held[slot], entry
            bucket = self._other(bucket, mark)
            if self._settle(bucket, mark, entry):
                return
        if 2 * self.live < len(self.held):
            self.overflow[entry[0]] = entry[1]
            self.live += 1
        else:
            self._grow(entry)

    def _settle(self, bucket: int, mark: int, entry: tuple) -> bool:
        for slot in range(bucket * _SLOTS, bucket * _SLOTS + _SLOTS):
            if not self.prints[slot]:
                self.prints[slot], self.held[slot] = mark, entry
                self.live += 1
                return True
        return False

    def _grow(self, homeless: tuple) -> None:
        entries = [*self.items(), homeless]
        self._size(2 * (self.mask + 1))
        for digest, value in entries:
            self._insert(digest, value)
