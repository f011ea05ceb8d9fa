"""Media columns: 8-bit audio, polyphase resampling, overlapped log-mel frames and energy segments.

A payload of bytes is stored losslessly as the samples of a mono 8-bit PCM wave file, read back from that
file, resampled by a rational factor with one FIR branch per output phase, cut into overlapped Hann
frames and projected on a mel filterbank. Frames are gathered in fixed-shape Arrow tensors, each with the
time span it covers; a hysteresis on frame energy (on at the upper, off below the lower threshold) gives
the segments. Long payloads are worked through in blocks of frames: the filters are local, so the result
is that of the whole while memory stays bounded apart from the stored bytes themselves. Arithmetic is in fixed
point, so equal texts give equal features on every machine.

Defined results: null is an empty text, whose payload is ``PAD`` zero bytes like that of the empty text;
equal texts give equal bytes and features; repeated rows give repeated results; an empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, texts, with_id

PAD = 64
RATE, UP, DOWN = 12_000, 2, 3  # input samples a second and the resampling ratio
OUT_RATE = RATE * UP // DOWN
TAPS = 12  # of each phase
FRAME, HOP, MELS = 200, 80, 24
TENSOR_FRAMES = 96
BLOCK_FRAMES = 64 * TENSOR_FRAMES
ON_DB, OFF_DB = 3.0, -3.0  # thresholds, from the median frame energy
HEADER = 44


def payload_of(text: str) -> bytes:
    """UTF-8 bytes padded with zeros to a positive multiple of ``PAD``."""
    raw = text.encode("utf-8", "replace")
    return raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def wav_encode(payload: bytes) -> bytes:
    """A RIFF/WAVE file with the payload as unsigned 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wav_decode(media: bytes) -> bytes:
    """The sample bytes of the first data chunk."""
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


#: Binary places of the fixed-point values: taps, resampled samples, window, Fourier tables, spectrum, filters, logarithms.
TAP, SAMPLE, WIN, TURN, SPECTRUM, MEL, LOG = 12, 14, 8, 12, 12, 8, 8
#: Added before a logarithm, as the power of two of the least unit: of a mel sum and of a frame's energy.
MEL_FLOOR, ENERGY_FLOOR = 12, 6
DB = 3.010299956639812  # decibels of a doubled power
LOG_STEPS = 1024  # of an octave


def fixed(values: np.ndarray, places: int) -> np.ndarray:
    return np.rint(values * 2.0**places)


def prototype() -> np.ndarray:
    """Windowed-sinc low-pass at the lower of the two Nyquist rates, as (phase, tap)."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1.0 / max(UP, DOWN)
    h = np.sinc(n * cut) * np.hanning(UP * TAPS + 2)[1:-1]
    return (h * UP / h.sum()).reshape(TAPS, UP).T


def filterbank() -> np.ndarray:
    """Triangular mel filters, (FRAME // 2 + 1, MELS)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, OUT_RATE / 2, FRAME // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def octave() -> np.ndarray:
    """Base-2 logarithms of the middles of ``LOG_STEPS`` steps from 0.5 to 1."""
    return np.log2(0.5 + (np.arange(LOG_STEPS) + 0.5) / (2 * LOG_STEPS))


_TURNS = 2 * np.pi / FRAME * np.outer(np.arange(FRAME // 2 + 1), np.arange(FRAME // 2 + 1))
BRANCHES, FILTERS, WINDOW = fixed(prototype(), TAP), fixed(filterbank(), MEL), fixed(np.hanning(FRAME + 1)[:-1], WIN)
COS, SIN, LOGS = fixed(np.cos(_TURNS), TURN), fixed(np.sin(_TURNS), TURN), fixed(octave(), LOG)


def log2(values: np.ndarray) -> np.ndarray:
    """Base-2 logarithms in units of 2**-LOG from the exact exponent and a table of the mantissa."""
    part, power = np.frexp(values)
    return power * 2.0**LOG + LOGS[((part - 0.5) * (2 * LOG_STEPS)).astype(np.int64)]


def windows(x: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of ``width`` values, each begun ``step`` after the one before, copied."""
    (stride,) = x.strides
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, ((len(x) - width) // step + 1, width), (step * stride, stride), writeable=False))


def resample(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Output samples first .. first + count of the polyphase resampler in units of 2**-SAMPLE; zeros surround the input."""
    low = first * DOWN // UP - TAPS // 2
    high = (first + count) * DOWN // UP + TAPS + 1
    x = np.zeros(high - low)
    a, b = max(low, 0), min(high, len(samples))
    if b > a:
        x[a - low : b - low] = samples[a:b].astype(np.float64) - 128
    out = np.empty(count)
    for k in range(UP):  # outputs of one phase read the input at a stride of DOWN
        m = first + k
        start = m * DOWN // UP - TAPS // 2 - low
        part = out[k::UP]
        part[:] = windows(x[start:], TAPS, DOWN)[: len(part)] @ BRANCHES[m * DOWN % UP][::-1]
    return np.floor(out * 2.0 ** (SAMPLE - TAP - 7))


def spectrum(frames: np.ndarray) -> np.ndarray:
    """Power of each frame's FRAME // 2 + 1 lowest frequencies, from its even and odd halves."""
    half = FRAME // 2
    mirror = frames[:, :half:-1]
    even, odd = frames[:, : half + 1].copy(), np.zeros((len(frames), half + 1))
    even[:, 1:half] += mirror
    np.subtract(frames[:, 1:half], mirror, out=odd[:, 1:half])
    scale = 2.0 ** (SPECTRUM - SAMPLE - TURN)
    return np.floor(even @ COS * scale) ** 2 + np.floor(odd @ SIN * scale) ** 2


def features(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n, MELS) in octaves and frame energies in dB (n,).

    All values but the logarithms' last products are whole numbers below 2**53 in float64, so sums don't hang
    on their order and results are the same on every kind of machine.
    """
    n_out = -(-len(samples) * UP // DOWN)
    n = max(1, -(-n_out // HOP))
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n)
    for f in range(0, n, BLOCK_FRAMES):
        k = min(BLOCK_FRAMES, n - f)
        y = resample(samples, f * HOP, (k - 1) * HOP + FRAME)
        frames = np.floor(windows(y, FRAME, HOP) * (WINDOW * 2.0**-WIN))
        sums = spectrum(frames) @ FILTERS + 2.0**MEL_FLOOR
        mels[f : f + k] = log2(sums) * 2.0**-LOG - (2 * SPECTRUM + MEL)
        squares = np.einsum("ij,ij->i", frames, frames) + 2.0**ENERGY_FLOOR
        energy[f : f + k] = (log2(squares) * 2.0**-LOG - 2 * SAMPLE) * DB
    return mels, energy


def segments(energy: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Frame ranges that a hysteresis keeps: begun at ``on`` or more, ended below ``off``."""
    mark = np.where(energy >= on, 1, np.where(energy < off, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    state = np.where(last >= 0, mark[last], 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], state, [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
STREAM = pa.schema([("log_mel", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def tensor_stream(mels: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors, each with the seconds it starts and ends at."""
    n = -(-len(mels) // TENSOR_FRAMES)
    padded = np.full((n * TENSOR_FRAMES, MELS), np.float32(MEL_FLOOR - 2 * SPECTRUM - MEL))
    padded[: len(mels)] = mels
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(padded.ravel(), TENSOR_FRAMES * MELS))
    starts = np.arange(n) * (TENSOR_FRAMES * HOP / OUT_RATE)
    ends = np.minimum((np.arange(n) + 1) * TENSOR_FRAMES, len(mels)) * (HOP / OUT_RATE)
    batch = pa.RecordBatch.from_arrays([tensors, pa.array(starts), pa.array(ends)], schema=STREAM)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STREAM) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    """The table in a ``tensors`` value: log_mel (fixed-shape tensor), start_s, end_s."""
    return pa.ipc.open_stream(stream).read_all()


def audio_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_bytes: int = 16_000_000) -> DataFrame:
    """(id_col, n_bytes long, media binary, tensors binary, segments array<struct<start_s, end_s>>) per row.

    ``media`` is the wave file, ``tensors`` an Arrow stream for ``read_tensors``. Results leave a task
    in batches of about ``out_bytes``.
    """
    source = id_and_text(df, id_col, text_col)
    second = HOP / OUT_RATE
    kinds = {"n_bytes": pa.int64(), "media": pa.binary(), "tensors": pa.binary(), "segments": pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))}

    def make():
        def step(batch):
            begin, rows, held = 0, [], 0
            for i, text in enumerate(texts(batch), 1):
                media = wav_encode(payload_of(text))
                mels, energy = features(np.frombuffer(wav_decode(media), np.uint8))
                middle = float(np.median(energy))
                spans = [{"start_s": a * second, "end_s": b * second} for a, b in segments(energy, middle + ON_DB, middle + OFF_DB)]
                rows.append((len(text.encode("utf-8", "replace")), media, tensor_stream(mels), spans))
                held += len(media) + len(rows[-1][2])
                if held >= out_bytes or i == batch.num_rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i - begin), *columns], ["id", *kinds])
                    begin, rows, held = i, [], 0

        return step

    schema = with_id(source, "n_bytes long, media binary, tensors binary, segments array<struct<start_s:double,end_s:double>>")
    return map_batches(source, make, schema).withColumnRenamed("id", id_col)


def wav_payload(media: str | Column) -> Column:
    """The sample bytes of a wave file made by ``audio_features``, as a column expression."""
    column = F.col(media) if isinstance(media, str) else media
    return F.substring(column, HEADER + 1, 2_147_483_647 - HEADER - 1)
