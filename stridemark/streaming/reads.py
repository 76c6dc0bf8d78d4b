"""Sketches of streams: whole reads without state, fragments of long sequences with a little."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stridemark.operators import kernel, sketch
from stridemark.params import Params


def read_syncmers(stream: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Syncmers of a stream of whole reads: stateless, in append mode, as ``sketch.syncmers`` gives for a table."""
    return sketch.syncmers(stream, p, keys, seq)


def fragment_syncmers(stream: DataFrame, p: Params) -> DataFrame:
    """(seq_id, pos, strand) of sequences that come in fragments (seq_id, fragment, seq), numbered from 0.

    Fragments of one sequence may come in any order and are used in theirs: the state is the last
    k - 1 bases, how many went before, and what came too early. A fragment that comes twice is used
    once; null ones are empty. What is found equals the result for the whole sequence.
    """
    if p.ambiguous == "compat_rolling" or p.approx16:
        raise ValueError("compat_rolling and approx16 depend on the whole sequence")
    sketch.ship(stream)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, offset, tail, early = state.get if state.exists else (0, 0, "", [])
        waiting = {int(x.split(":", 1)[0]): x.split(":", 1)[1] for x in early}
        for frame in frames:
            for i, seq in zip(frame["fragment"], frame["seq"], strict=True):
                if i is not None and int(i) >= number:
                    waiting.setdefault(int(i), seq if isinstance(seq, str) else "")
        ready = []
        while number in waiting:
            ready.append(waiting.pop(number))
            number += 1
        text = tail + "".join(ready)
        found = kernel.syncmers([text.encode()], p)
        keep = text[max(0, len(text) - (p.k - 1)) :]
        state.update((number, offset + len(text) - len(keep), keep, [f"{i}:{x}" for i, x in waiting.items()]))
        if len(found.pos):
            yield pd.DataFrame({"seq_id": key[0], "pos": found.pos + offset, "strand": found.strand.astype("int32")})

    kind = dict(stream.dtypes)["seq_id"]
    return stream.groupBy("seq_id").applyInPandasWithState(
        step, f"seq_id {kind}, pos long, strand int", "number long, start long, tail string, early array<string>", "append", GroupStateTimeout.NoTimeout
    )
