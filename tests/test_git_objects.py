"""Loose and packed objects against what git itself says."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.sources import git_objects


def git(folder, *args):
    env = {"GIT_AUTHOR_NAME": "Ann O", "GIT_AUTHOR_EMAIL": "a@x.org", "GIT_COMMITTER_NAME": "Bo", "GIT_COMMITTER_EMAIL": "b@x.org", "GIT_AUTHOR_DATE": "1700000000 +0200", "GIT_COMMITTER_DATE": "1700000100 +0000", "HOME": str(folder), "PATH": "/usr/bin:/bin:/usr/local/bin"}
    return subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env=env).stdout.decode()


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("repo"), random.Random(3)
    git(folder, "init", "-q", "-b", "main")
    lines = [f"line {rng.random()}" for _ in range(400)]
    for k in range(12):
        lines[rng.randrange(400)] = f"changed {k}"
        (folder / "sub/deep").mkdir(parents=True, exist_ok=True)
        (folder / "big.txt").write_text("\n".join(lines))
        (folder / f"sub/deep/é{k}.py").write_text(f"x = {k}\n")
        git(folder, "add", "-A")
        git(folder, "commit", "-q", "-m", f"Change {k}\nsecond line\n\nBody of {k}")
    git(folder, "checkout", "-q", "-b", "side", "HEAD~3")
    (folder / "side.txt").write_text("s")
    git(folder, "add", "-A")
    git(folder, "commit", "-q", "-m", "Side")
    git(folder, "merge", "-q", "--no-edit", "main")
    git(folder, "gc", "-q", "--aggressive")
    (folder / "loose.txt").write_text("loose")
    git(folder, "add", "-A")
    git(folder, "commit", "-q", "-m", "Loose")
    return folder


def test_objects_and_types(spark, repository):
    found = git_objects.objects(spark, str(repository / ".git"), 7)
    said = sorted(tuple(x.split(" ")) for x in git(repository, "cat-file", "--batch-check", "--batch-all-objects").splitlines())
    assert sorted((r.sha, r.type, str(r.size)) for r in found.collect()) == said
    assert found.rdd.getNumPartitions() > 5
    # contents hash to their names, chains of deltas included
    whole = F.sha1(F.concat(F.concat_ws(" ", "type", F.col("size").cast("string")).cast("binary"), F.lit(b"\0"), "content"))
    assert found.where(whole != F.col("sha")).count() == 0
    with git_objects.Pack(str(next((repository / ".git/objects/pack").glob("*.pack")))) as pack:
        assert sum(pack.entry(o)[2] is not None for o in pack.offsets) > 5
    only = found.where("type = 'commit'")
    assert only.count() == sum(t == "commit" for _, t, _ in said)


def test_commits_and_files(spark, repository):
    found = git_objects.objects(spark, str(repository / ".git"))
    got = git_objects.commits(found)
    rows = sorted((r.sha, r.tree, " ".join(r.parents), r.author, r.email, int(r.authored_at.timestamp()), int(r.committed_at.timestamp()), r.subject) for r in got.collect())
    said = [x.split("\x01") for x in git(repository, "log", "--all", "--format=%H%x01%T%x01%P%x01%an%x01%ae%x01%at%x01%ct%x01%s").splitlines()]
    assert rows == sorted((h, t, p, a, e, int(x), int(y), s) for h, t, p, a, e, x, y, s in said)
    assert max(len(r.parents) for r in got.collect()) == 2
    roots = got.where(F.col("sha").isin(git(repository, "rev-parse", "side").strip(), git(repository, "rev-parse", "main").strip())).select("tree")
    files = git_objects.files(git_objects.tree_entries(found), roots)
    for branch in ("side", "main"):
        root = git(repository, "rev-parse", f"{branch}^{{tree}}").strip()
        listed = git(repository, "-c", "core.quotepath=false", "ls-tree", "-r", branch).splitlines()
        expected = sorted((x.split("\t")[1], x.split(" ")[0], x.split("\t")[0].split(" ")[2]) for x in listed)
        assert sorted((r.path, r.mode, r.sha) for r in files.where(F.col("root") == root).collect()) == expected


def test_an_empty_store(spark, tmp_path):
    (tmp_path / "objects").mkdir()
    assert git_objects.objects(spark, str(tmp_path)).count() == 0


def test_deltas_are_checked():
    assert git_objects.patched(b"abcdef", bytes([6, 5, 0b10010001, 1, 3, 2]) + b"xy") == b"bcdxy"
    with pytest.raises(ValueError):
        git_objects.patched(b"abc", bytes([6, 5]))
