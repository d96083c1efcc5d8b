"""Client ids, routing and hashing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def client_id_parts(client_id: Column) -> dict[str, Column]:
    """ip, port and pid of a client id held as BIGINT (its 64 bits): ip << 32 | port << 16 | pid."""
    c = client_id.cast("long")
    return {"ip": F.shiftrightunsigned(c, 32), "port": F.shiftrightunsigned(c, 16).bitwiseAND(0xFFFF), "pid": c.bitwiseAND(0xFFFF)}


def pack_client_id(ip: Column, port: Column, pid: Column) -> Column:
    """The 64 bits of a client id as BIGINT."""
    return F.shiftleft(ip.cast("long"), 32).bitwiseOR(F.shiftleft(port.cast("long"), 16)).bitwiseOR(pid.cast("long").bitwiseAND(0xFFFF))


def unsigned(bits: Column) -> Column:
    """A BIGINT's bits as DECIMAL(20, 0)."""
    d = bits.cast("decimal(20,0)")
    return F.when(bits < 0, d + F.lit(2**64).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def recorder_of(event_time: Column, recorders: int) -> Column:
    """The recorder that an event's time is dealt to."""
    return F.pmod(event_time, F.lit(recorders))


def finalize(h: np.ndarray) -> np.ndarray:
    """The published SplitMix64 finalizer on unsigned 64-bit numbers, which wrap."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def group_of(story_id: Column, groups: Sequence[int]) -> Column:
    """Rendezvous hashing: the active group with the highest mixed weight for a story; the lower id wins ties.

    Products wrap at 64 bits, which SQL arithmetic refuses, hence NumPy on Arrow batches.
    """
    ids = np.array(sorted(groups), dtype=np.uint64)

    @F.pandas_udf("long")
    def pick(story: pd.Series) -> pd.Series:
        s = story.to_numpy(dtype=np.int64).view(np.uint64)
        weights = np.stack([finalize(s ^ finalize(np.full(1, g, np.uint64))) for g in ids])
        return pd.Series(ids[weights.argmax(0)].astype(np.int64))

    return pick(story_id)
