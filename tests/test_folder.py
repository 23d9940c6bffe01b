import os

import pytest

from scrollmill.operators.folder import FolderIndex
from scrollmill.sources import files

CHAT = "---\ntitle: {t}\nplatform: Claude\nfingerprint: f{n}\n---\n\n# {t}\n\n## User\n\nabout {t} widgets\n\n## Assistant\n\n```swift\nlet {t} = 1\n```\n"


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "archive"
    (at / "sub").mkdir(parents=True)
    for n, t in enumerate(["apples", "pears", "plums"]):
        (at / ("sub" if n else ".") / f"{t}.md").write_text(CHAT.format(t=t, n=n))
    (at / "foreign.md").write_text("# Notes\n\n## User\n\non widgets\n\n## Assistant\n\nmore widgets")
    (at / "bad.md").write_bytes(b"\xff\xfe\x00\x01")
    (at / ".hidden.md").write_text("hidden widgets")
    (at / "other.txt").write_text("text widgets")
    return at


def counters(df):
    r = df.first()
    return r["indexed"], r["unchanged"], r["removed"], r["failed"], r["total"]


def hits(index, q):
    return sorted({os.path.basename(r["path"]) for r in index.index.search(q).collect()})


def test_passes(spark, folder, tmp_path, monkeypatch):
    index = FolderIndex(spark, f"file://{tmp_path}/state", f"file://{folder}")
    assert counters(index.run()) == (4, 0, 0, 1, 4)
    assert hits(index, "widgets") == ["apples.md", "foreign.md", "pears.md", "plums.md"] and hits(index, "hidden") == []
    rows = {os.path.basename(r["path"]): r for r in index.documents.read().collect()}
    assert (rows["pears.md"]["title"], rows["pears.md"]["turn_count"], rows["pears.md"]["fingerprint"], rows["pears.md"]["tags"]) == ("pears", 2, "f1", ["code", "swift"])
    assert (rows["foreign.md"]["title"], rows["foreign.md"]["turn_count"], rows["foreign.md"]["fingerprint"]) == ("", 2, "")
    # Nothing has changed, and the unreadable file is tried again; only it is opened.
    opened = []
    monkeypatch.setattr("scrollmill.operators.folder.read_files", lambda s, f, wanted: opened.append(sorted(os.path.basename(r["path"]) for r in wanted.collect())) or files.read_files(s, f, wanted))
    assert counters(index.run()) == (0, 4, 0, 1, 4) and opened == [["bad.md"]]
    # One edited, one renamed, one deleted, one new, one mended.
    (folder / "sub" / "pears.md").write_text(CHAT.format(t="quinces", n=7) + "\nlonger")
    (folder / "sub" / "plums.md").rename(folder / "prunes.md")
    (folder / "apples.md").unlink()
    (folder / "new.md").write_text("## User\n\nfresh widgets")
    (folder / "bad.md").write_text("## User\n\nmended widgets")
    assert counters(index.run()) == (4, 1, 2, 0, 5)
    assert hits(index, "widgets") == ["bad.md", "foreign.md", "new.md", "pears.md", "prunes.md"]
    assert hits(index, "quinces") == ["pears.md"] and hits(index, "pears") == hits(index, "apples") == []
    assert counters(index.run(force=True)) == (5, 0, 0, 0, 5) and hits(index, "mended") == ["bad.md"]
    # A file that turns unreadable keeps what was known of it.
    (folder / "new.md").write_bytes(b"\xff\xff")
    assert counters(index.run()) == (0, 4, 0, 1, 4) and hits(index, "fresh") == ["new.md"]
    folder.rename(tmp_path / "away")
    assert counters(index.run()) == (0, 0, 0, 0, 0) and hits(index, "quinces") == ["pears.md"]


def test_many_changed_files_are_read_from_the_folder(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BY_NAME", 1)
    index = FolderIndex(spark, f"file://{tmp_path}/state", f"file://{folder}")
    assert counters(index.run()) == (4, 0, 0, 1, 4) and hits(index, "plums") == ["plums.md"]


def test_a_pass_that_dies_is_made_up_for(spark, folder, tmp_path, monkeypatch):
    index = FolderIndex(spark, f"file://{tmp_path}/state", f"file://{folder}")
    monkeypatch.setattr(type(index.documents), "replace", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.run()
    monkeypatch.undo()
    assert counters(index.run()) == (4, 0, 0, 1, 4)
    assert len(index.index.search("widgets").collect()) == 5 and index.index.latest().messages == 8
