"""How much of an archive is read to salvage it."""

from __future__ import annotations

import random

from test_archives import plain_record, split

from packlens.llm import warc


class Counted:
    """A file that counts what is asked of it."""

    def __init__(self, file):
        self.file, self.bytes = file, 0

    def read_at(self, n, start):
        self.bytes += n
        return self.file.read_at(n, start)


def opened(path):
    source = warc.Opened(str(path))
    source.file = Counted(source.file)
    return source


def test_small_members_are_read_once(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_FETCH", 1 << 16)
    rng = random.Random(1)
    data = b"".join(warc.members(plain_record(i, rng.randbytes(rng.randint(0, 3000)))) for i in range(1500))
    (tmp_path / "a.gz").write_bytes(data)
    source = opened(tmp_path / "a.gz")
    ids, gaps = split(warc.salvage(source))
    assert len(ids) == 1500 and gaps == []
    assert source.file.bytes <= 2 * len(data)
    assert split(warc.salvage(warc.Held(data))) == (ids, gaps)


def test_large_members_and_damage_are_read_a_few_times(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_FETCH", 1 << 16)
    rng = random.Random(2)
    parts = [warc.members(plain_record(i, rng.randbytes(400_000 if i % 5 == 0 else 500))) for i in range(40)]
    parts[7] = parts[7][:60] + b"\0" * 40 + parts[7][100:]
    data = b"".join(parts)
    (tmp_path / "b.gz").write_bytes(data)
    source = opened(tmp_path / "b.gz")
    got = split(warc.salvage(source))
    assert got == split(warc.salvage(warc.Held(data))) and len(got[0]) == 39 and len(got[1]) == 1
    assert source.file.bytes <= 4 * len(data)


def test_reads_anywhere_give_the_files_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_FETCH", 100)
    rng = random.Random(3)
    data = rng.randbytes(5000)
    (tmp_path / "c").write_bytes(data)
    source = opened(tmp_path / "c")
    at = 0
    for _ in range(3000):
        at = rng.randrange(5100) if rng.random() < 0.2 else min(5050, at + rng.randrange(60))
        n = rng.randrange(300)
        assert source.read(at, n) == data[at : at + n]
