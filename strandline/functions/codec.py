"""[SCL-9] Compressed text as the stores of other systems hold it: base64 of zlib at level 9."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import pyarrow as pa

from strandline.functions.batches import by_slices


def _each(one: Callable[[str], str]) -> Callable[[list[str | None]], pa.Array]:
    return lambda texts: pa.array([None if t is None else one(t) for t in texts], pa.string())


def _pack(code: str) -> str:
    return base64.b64encode(zlib.compress(code.encode(), 9)).decode()


def _unpack(packed: str) -> str:
    try:
        return zlib.decompress(base64.b64decode(packed, validate=True)).decode()
    except (ValueError, zlib.error):
        return packed


compress_code = by_slices(_each(_pack), "string")
#: The text of compressed code; what is no such text comes back as it is.
decompress_code = by_slices(_each(_unpack), "string")
