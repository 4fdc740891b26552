"""Checkpoint notation ``[N|mm:ss:cc]letter`` in numpy: one row per letter, a slice of text at a time.

Letters are many for their input (a text has ten times as many stamps and letters as words), so no expression looks at one of them alone.
A slice ends at a line break; a longer line is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are read at once, and rows that are handed on at once.
SLICE, ROWS = 1 << 20, 1 << 16
BREAK, OPEN, BAR, COLON, CLOSE, ZERO = b"\n[|:]0"
#: Bytes of a letter by its first byte.
_SIZE = np.ones(256, dtype=np.int64)
_SIZE[0xC0:0xE0], _SIZE[0xE0:0xF0], _SIZE[0xF0:] = 2, 3, 4
#: ``:ss:cc]`` of every hundredth of a minute.
_SECONDS = np.frombuffer(b"".join([b":%02d:%02d]" % divmod(t, 100) for t in range(6000)]), dtype=np.uint8).reshape(-1, 7)


def _slices(texts: pa.Array) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, lines before, text), together about one slice; every text stands without its last line break."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if not text.is_valid:
            continue
        text = text.as_buffer().to_pybytes()
        if b"\r" in text:
            text = text.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        at = before = 0
        while True:
            end = len(text) if len(text) - at <= SLICE else max(text.rfind(b"\n", at, at + SLICE), -1)
            if end < 0:
                end = text.find(b"\n", at + SLICE)
                end = len(text) if end < 0 else end
            held.append((row, before, text[at:end]))
            size += end - at + 1
            if size >= SLICE:
                yield held
                held, size = [], 0
            if end == len(text):
                break
            before += text.count(b"\n", at, end) + 1
            at = end + 1
    if held:
        yield held


def _run_end(digit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the digits from each place on end."""
    end = at.copy()
    live = np.nonzero(digit[end])[0]
    while len(live):
        end[live] += 1
        live = live[digit[end[live]]]
    return end


def _numbers(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers between two places each, and whether they have at most 18 digits behind their leading zeros."""
    value, fits = np.zeros(len(lo), dtype=np.int64), np.ones(len(lo), dtype=bool)
    size = hi - lo
    most = int(size.max(initial=0))
    if most <= 8:  # as good as all: no number leaves the plain path
        for k in range(most):
            more = value * 10 + (data[lo + k] - ZERO)
            value = more if k == 0 else np.where(size > k, more, value)
        return np.where(size > 0, value, 0), fits
    for k in range(most):
        live = np.nonzero(size > k)[0]
        fits[live] &= value[live] < 10**17
        live = live[fits[live]]
        value[live] = value[live] * 10 + (data[lo[live] + k] - ZERO)
    return value, fits


def letters(part: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(row, line_no, char_no, offsets, bytes, count, count known, line end, ms, ms known) of all letters of a slice."""
    joined = b"\n".join([text for _, _, text in part]) + b"\n"
    data = np.frombuffer(joined + bytes(16), dtype=np.uint8)
    digit = (data - ZERO) < 10
    # stamps
    p = np.nonzero(data == OPEN)[0]
    bar = _run_end(digit, p + 1)
    ok = (bar > p + 1) & (data[bar] == BAR)
    p, bar = p[ok], bar[ok]
    colon = _run_end(digit, bar + 1)
    ok = (colon > bar + 1) & (data[colon] == COLON)
    tail = [data[colon + j] - ZERO for j in range(1, 7)]  # ss:cc]
    ok &= (tail[2] == COLON - ZERO) & (tail[5] == CLOSE - ZERO)
    for j in (0, 1, 3, 4):
        ok &= tail[j] < 10
    if not ok.all():
        p, bar, colon, tail = p[ok], bar[ok], colon[ok], [x[ok] for x in tail]
    end = colon + 7
    # bytes of letters, and the rows: letters, and stamps that no letter follows
    edge = np.zeros(len(joined) + 1, dtype=np.int8)
    edge[p] += 1
    edge[end] -= 1
    letter = np.cumsum(edge[:-1], dtype=np.int8) == 0
    body = data[: len(joined)]
    breaks = body == BREAK
    letter &= ~breaks
    bare = (data[end] == BREAK) | (data[end] == OPEN)
    first = letter & ((body & 0xC0) != 0x80)
    first[p[bare]] = True
    at = np.nonzero(first)[0]
    holder = np.where(bare, p, end)
    carries = np.zeros(len(joined), dtype=bool)
    carries[holder] = True
    empty = np.zeros(len(joined), dtype=bool)
    empty[p[bare]] = True
    offsets = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(np.where(empty[at], 0, _SIZE[body[at]]), out=offsets[1:])
    text_bytes = body[letter]
    if offsets[-1] != len(text_bytes):  # no UTF-8: bytes that begin no letter stay with the one before
        offsets = np.append((np.cumsum(letter) - letter)[at], len(text_bytes))
        offsets[0] = 0
    # lines: every text of the slice ends with a break
    stops = np.nonzero(breaks)[0]
    upto = np.searchsorted(at, stops)
    from_ = np.concatenate([[0], upto[:-1]])
    count = upto - from_
    ends = np.cumsum([len(text) + 1 for _, _, text in part]) - 1
    text_of = np.searchsorted(ends, stops)
    line_first = np.concatenate([[0], np.searchsorted(stops, ends[:-1]) + 1])
    line_no = np.arange(len(stops)) - line_first[text_of] + np.array([b for _, b, _ in part], dtype=np.int64)[text_of] + 1
    row = np.array([r for r, _, _ in part], dtype=np.int64)[text_of]
    char_no = np.arange(1, len(at) + 1) - np.repeat(from_, count)
    # what the stamps say
    closing = (bar - p > 2) & (data[bar - 1] == ZERO)
    n, fits = _numbers(data, p + 1, bar - closing)
    minutes, known = _numbers(data, bar + 1, colon)
    known &= minutes < 10**13
    rest = (tail[0] * 10 + tail[1]) * np.int64(1000) + (tail[3] * 10 + tail[4]) * np.int64(10)
    where = np.nonzero(carries[at])[0]
    beats, ended, ms = np.zeros(len(at), dtype=np.int32), np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)
    no_beats, no_ms = np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    fits &= n < 1 << 31
    beats[where], ended[where], no_beats[where] = np.where(fits, n, 0), closing, ~fits
    ms[where], no_ms[where] = np.where(known, minutes, 0) * 60_000 + rest, ~known
    return np.repeat(row, count), np.repeat(line_no, count), char_no, offsets, text_bytes, beats, no_beats, ended, ms, no_ms


def read_letters(content: str, keys: list[str]):
    """For mapInArrow: (keys, content) -> (keys, line_no, char_no, ch, check_count, is_line_end, ms)."""

    def run(parts):
        for b in parts:
            own = b.select(keys)
            for part in _slices(b.column(content).cast(pa.large_binary())):
                row, line_no, char_no, offsets, text, beats, no_beats, ended, ms, no_ms = letters(part)
                ch = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(offsets), pa.py_buffer(text)).cast(pa.string())
                columns = [pa.array(line_no), pa.array(char_no), ch, pa.array(beats, mask=no_beats), pa.array(ended), pa.array(ms, mask=no_ms)]
                for lo in range(0, len(row), ROWS):
                    held = own.take(pa.array(row[lo : lo + ROWS]))
                    rest = [c.slice(lo, ROWS) for c in columns]
                    yield pa.RecordBatch.from_arrays([*held.columns, *rest], [*keys, "line_no", "char_no", "ch", "check_count", "is_line_end", "ms"])

    return run


def _written(lines: list[bytes], starts: np.ndarray, step: int) -> bytes:
    """Lines in the notation: letter k of a line (from 1) has a stamp unless 4 divides k, of k % 3 + 1 beats, ``step`` ms (a multiple of 10) after the one before."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    # a row per letter, and one for a line without any, which is its break
    breaks = data == BREAK
    blank = breaks & np.concatenate([[True], breaks[:-1]])
    first = ((data & 0xC0) != 0x80) & (~breaks | blank)
    at = np.nonzero(first)[0]
    upto = np.searchsorted(at, np.nonzero(breaks)[0] + 1)
    from_ = np.concatenate([[0], upto[:-1]])
    count = upto - from_
    k = np.arange(1, len(at) + 1) - np.repeat(from_, count)
    last = np.zeros(len(at), dtype=bool)
    last[upto - 1] = True
    t = np.repeat(starts // 10, count) + (k - 1) * (step // 10)
    small = int(t.max()) < 1 << 31
    k, t = (k.astype(np.int32), t.astype(np.int32)) if small else (k, t)
    minutes = t // 6000
    low, wide = int(minutes.min()), max(2, len(str(int(minutes.max()))))
    stamped = k % 4 != 0
    # [ N 0 | minutes : ss : cc ] letter break
    out = np.zeros((len(at), wide + 16), dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = OPEN, k % 3 + (1 + ZERO), np.where(last, ZERO, 0), BAR
    clocks = np.frombuffer(b"".join([(b"%02d" % m).ljust(wide, b"\0") for m in range(low, int(minutes.max()) + 1)]), dtype=np.uint8).reshape(-1, wide)
    for table, of, first_column in ((clocks, minutes - low, 4), (_SECONDS, t - minutes * 6000, 4 + wide)):
        for j in range(table.shape[1]):
            out[:, first_column + j] = np.ascontiguousarray(table[:, j])[of]
    out[~stamped, : 11 + wide] = 0
    held = out != 0
    size = np.where(blank[at], 0, _SIZE[data[at]])
    for j in range(int(size.max())):
        held[:, 11 + wide + j] = live = size > j
        out[live, 11 + wide + j] = data[at[live] + j]
    out[last, 15 + wide], held[last, 15 + wide] = BREAK, True
    return out[held].tobytes()[:-1]


def write_letters(first_ms: int, step: int):
    """For mapInArrow: (file_id, text) -> (file_id, content); line i (from 1) of a file starts at i * first_ms + file_id % 1000 ms, cut to 10 ms."""

    def run(parts):
        for b in parts:
            for lo in range(0, b.num_rows, 64):
                ids, out = b.column(0).slice(lo, 64), []
                for file_id, text in zip(ids.to_pylist(), b.column(1).slice(lo, 64).cast(pa.large_binary()).to_pylist()):
                    if file_id is None or text is None:
                        out.append(None)
                        continue
                    lines = text.split(b"\n")
                    starts = (np.arange(1, len(lines) + 1) * first_ms + int(np.fmod(file_id, 1000))) // 10 * 10
                    cuts = np.unique(np.cumsum([len(line) + 1 for line in lines]) // (SLICE // 8), return_index=True)[1].tolist() + [len(lines)]
                    out.append(b"\n".join([_written(lines[i:j], starts[i:j], step) for i, j in zip(cuts, cuts[1:])]))
                content = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, content], ["file_id", "content"])

    return run
