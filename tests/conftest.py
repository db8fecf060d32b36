import os
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.cloudpickle import register_pickle_by_value

# Workers cannot import this file.
register_pickle_by_value(sys.modules[__name__])
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glyphlake.session import local_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return TESTDATA


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG of a gray or RGB array, rows stored with the Sub filter."""
    planes = pixels[..., None] if pixels.ndim == 2 else pixels
    h, w, n = planes.shape
    left = np.concatenate([np.zeros((h, 1, n), np.uint8), planes[:, :-1]], axis=1)
    lines = np.concatenate([np.ones((h, 1), np.uint8), (planes - left).reshape(h, w * n)], axis=1)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The pixels that ``png_bytes`` has written: the tests' stand-in for a user's image library."""
    if data[:4] != b"\x89PNG":
        raise ValueError("not a PNG")
    w, h, _, kind = struct.unpack(">IIBB", data[16:26])
    at = data.index(b"IDAT") + 4
    lines = np.frombuffer(zlib.decompress(data[at:-16]), np.uint8).reshape(h, -1)[:, 1:].reshape(h, w, 3 if kind == 2 else 1)
    pixels = np.cumsum(lines, axis=1, dtype=np.uint64).astype(np.uint8)
    return pixels if kind == 2 else pixels[..., 0]


def vectors(n: int, dims: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)
