"""Archives read as ranges, against the standard library's reader."""

import gzip
import hashlib
import io
import tarfile

import pytest

from corroborate.sources import archive


def put(tar, name, data=b"", kind=tarfile.REGTYPE, link=""):
    info = tarfile.TarInfo(name)
    info.type, info.linkname, info.size = kind, link, len(data)
    tar.addfile(info, io.BytesIO(data))


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """An archive with long names, links, an archive within, empty files, layers, and data that looks like headers."""
    folder = tmp_path_factory.mktemp("tar")
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as tar:
        put(tar, "inside.txt", b"never a member")
    paths = []
    for fmt in (tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT):
        path = folder / f"a{fmt}.tar"
        with tarfile.open(path, "w", format=fmt) as tar:
            put(tar, "./", kind=tarfile.DIRTYPE)
            put(tar, "./etc/", kind=tarfile.DIRTYPE)
            put(tar, "./etc/empty")
            put(tar, "nested.tar", inner.getvalue())
            put(tar, "d" * 60 + "/" + "n" * 80, b"long name" * 1000)
            if fmt != tarfile.USTAR_FORMAT:
                put(tar, "x" * 300, b"longer name")
                put(tar, "link2", kind=tarfile.SYMTYPE, link="t" * 200)
            put(tar, "lnk", kind=tarfile.SYMTYPE, link="etc/empty")
            for n in range(3):
                put(tar, f"layer{n}.tar.gz", gzip.compress(bytes(100_000 * (n + 1))))
            put(tar, "broken.gz", b"\x1f\x8b" + b"no gzip")
            put(tar, "big", bytes(range(256)) * 12_000)
        paths.append(str(path))
    return paths


def test_members_are_those_of_the_standard_reader(spark, made):
    found = {}
    for r in archive.stream_members(spark, [f"file://{p}" for p in made]).collect():
        found.setdefault(r.archive.removeprefix("file://"), []).append(r)
    for path in made:
        rows = sorted(found[path], key=lambda r: r.seq)
        with tarfile.open(path) as tar:
            want = [(m.name.removeprefix("./"), "file" if m.isreg() else "symlink" if m.issym() else "directory", m.size, hashlib.sha256(tar.extractfile(m).read()).hexdigest() if m.isreg() else None, m.linkname if m.issym() else None) for m in tar]
        assert [(r.path, r.kind, r.size, r.sha256, r.target) for r in rows] == want
        assert {r.path: r.inflated for r in rows if r.path.endswith("gz")} == {"layer0.tar.gz": 100_000, "layer1.tar.gz": 200_000, "layer2.tar.gz": 300_000, "broken.gz": None}


def test_layers_and_rules(spark, made, tmp_path):
    members = archive.stream_members(spark, [f"file://{made[0]}"])
    assert [(r.path, r.layer, r.total) for r in archive.layer_sums(members).orderBy("seq").collect()] == [("layer0.tar.gz", 1, 100_000), ("layer1.tar.gz", 2, 300_000), ("layer2.tar.gz", 3, 600_000)]
    assert {(r.path, r.rule) for r in archive.layer_violations(members, 2, 10**6, 250_000).collect()} == {("layer2.tar.gz", "layers"), ("layer1.tar.gz", "uncompressed"), ("big", "compressed")}
    assert archive.layer_violations(members, 3, 10**8, 10**6).isEmpty() and archive.member_violations(members, 100, 10**8).isEmpty()
    path = str(tmp_path / "bad.tar")
    with tarfile.open(path, "w") as tar:
        for name, kind in (("a/../b", tarfile.REGTYPE), ("/abs", tarfile.REGTYPE), ("same", tarfile.REGTYPE), ("same", tarfile.REGTYPE), ("hard", tarfile.LNKTYPE), ("dev", tarfile.CHRTYPE), (".", tarfile.REGTYPE)):
            put(tar, name, b"12345" if kind == tarfile.REGTYPE else b"", kind, "same" if kind == tarfile.LNKTYPE else "")
    found = {(r.path, r.rule) for r in archive.member_violations(archive.stream_members(spark, [f"file://{path}"]), 5, 19).collect()}
    assert found == {("a/../b", "path"), ("/abs", "path"), ("same", "repeated"), ("hard", "kind"), ("dev", "kind"), (".", "root"), (None, "members"), (None, "bytes")}


def test_cut_archives_are_errors(spark, made, tmp_path):
    whole = open(made[0], "rb").read()
    for name, data in (("cut", whole[: 512 * 40]), ("junk", whole[:512] + b"x" * 512 * 3), ("none", b"y" * 1024)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="archive"):
            archive.stream_members(spark, [f"file://{tmp_path / name}"]).collect()
    (tmp_path / "odd").write_bytes(whole[:700])
    with pytest.raises(ValueError, match="no archive"):
        archive.stream_members(spark, [f"file://{tmp_path / 'odd'}"])


def test_an_archive_above_two_gigabytes(spark, tmp_path):
    """Beyond what one row may hold: a member of 2.2 GB of zeros between two small ones."""
    path, size = tmp_path / "huge.tar", 2_200 * (1 << 20)
    with tarfile.open(path, "w", format=tarfile.GNU_FORMAT) as tar:
        put(tar, "first", b"1")
        info = tarfile.TarInfo("huge")
        info.size = size
        head = info.tobuf(tarfile.GNU_FORMAT)
        tar.fileobj.write(head)
        tar.fileobj.seek(size, 1)
        tar.offset += len(head) + size
        put(tar, "last", b"2")
    rows = archive.stream_members(spark, [f"file://{path}"]).orderBy("seq").collect()
    path.unlink()
    zeros = hashlib.sha256()
    for _ in range(2_200):
        zeros.update(bytes(1 << 20))
    assert [(r.path, r.size) for r in rows] == [("first", 1), ("huge", size), ("last", 1)] and rows[1].sha256 == zeros.hexdigest()
