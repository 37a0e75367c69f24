"""Sorted hash arrays in files of the shared folder, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs

from tessella.llm.common import mix
from tessella.llm.files import open_store

#: Values that a worker gathers before it emits partial sums.
FLUSH = 4 << 20


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each uniform 64-bit key; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted array of unsigned 64-bit integers as compressed differences."""
    steps = np.diff(values, prepend=np.zeros(1, np.uint64))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return pack_sorted(np.cumsum(values, dtype=np.uint64))


def unpack_counts(data: bytes) -> np.ndarray:
    return np.diff(unpack_sorted(data), prepend=np.zeros(1, np.uint64))


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of each value."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def distinct_pairs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (low, high) in their order, and the place of each pair among them."""
    order = np.argsort(low, kind="stable")
    a, b = low[order], high[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((high, low))
        a, b = low[order], high[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return a[new], b[new], back


def blobs(shard: np.ndarray, keys: np.ndarray, values: np.ndarray):
    """(shard, keys, values) rows of sorted keys, packed; shard numbers go with the keys."""
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    shard, keys, values = shard[order], keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, int)
    ends = np.append(first[1:], len(shard))
    rows = [(int(shard[a]), pack_sorted(keys[a:b]), pack_counts(values[a:b])) for a, b in zip(first, ends)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])


def write_arrays(folder: str, *arrays: np.ndarray) -> str:
    """A new file with the arrays one after another, each from a multiple of 8 bytes; its name is of this attempt only."""
    store, root = open_store(folder)
    name = f"{uuid.uuid4().hex}.bin"
    with store.open_output_stream(f"{root}/{name}") as out:
        for a in arrays:
            data = np.ascontiguousarray(a).view(np.uint8).tobytes()
            out.write(data + bytes(-len(data) % 8))
    return f"{folder}/{name}"


_local: dict[str, str] = {}


def map_arrays(file: str, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays (type, length) of a file, memory-mapped; a file of a remote store is copied once per worker."""
    store, path = open_store(file)
    if not isinstance(store, fs.LocalFileSystem):
        if file not in _local:
            _local[file] = os.path.join(tempfile.mkdtemp(), "shard")
            fs.copy_files(path, _local[file], source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        path = _local[file]
    whole = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(whole[at : at + size].view(kind))
        at += size + -size % 8
    return out


class HashStore:
    """Shards of sorted keys with values: shards[k] is (file, keys), in order of shard."""

    def __init__(self, shards: dict[int, tuple[str, int]], count: int, kinds: list[str], mixed: bool = False):
        self.shards, self.count, self.kinds, self.mixed = shards, count, kinds, mixed
        self.mapped: dict[int, list[np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"mapped": {}}

    def shard(self, k: int) -> list[np.ndarray]:
        if k not in self.mapped:
            file, n = self.shards[k]
            self.mapped[k] = map_arrays(file, [("u8", n)] + [(kind, n) for kind in self.kinds])
        return self.mapped[k]

    def find_pairs(self, low: np.ndarray, high: np.ndarray):
        """As find, for keys whose second halves are the first values of the store; keys of one first half are next to each other."""
        for at, k, place in self.find(low):
            own, wanted = self.shard(k)[1], high[at]
            keys = self.shard(k)[0]
            for _ in range(64):
                wrong = np.flatnonzero(own[place] != wanted)
                more = wrong[place[wrong] + 1 < len(own)]
                more = more[keys[place[more] + 1] == low[at[more]]]
                if not len(more):
                    break
                place = place.copy()
                place[more] += 1
            else:  # very many keys have one first half
                for x in np.flatnonzero(own[place] != wanted).tolist():
                    run = slice(*(int(np.searchsorted(keys, low[at[x]], side)) for side in ("left", "right")))
                    place[x] = min(run.start + int(np.searchsorted(own[run], wanted[x])), len(own) - 1)
            hit = own[place] == wanted
            yield at[hit], k, place[hit]

    def find(self, keys: np.ndarray):
        """(places in keys, shard, first places in the shard) of the sorted keys that are there."""
        where = shard_of(mix(keys) if self.mixed else keys, self.count).astype(np.uint32)
        order = np.argsort(where, kind="stable")
        where = where[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, int)
        for a, b in zip(first, np.append(first[1:], len(where))):
            k = int(where[a])
            if k in self.shards and self.shards[k][1]:
                own, wanted = self.shard(k)[0], keys[order[a:b]]
                at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                hit = own[at] == wanted
                yield order[a:b][hit], k, at[hit]
