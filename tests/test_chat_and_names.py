"""The stateful chat stream against its batch form, over a restart; names across modules."""

import json
import os
import random

from pyspark.sql import functions as F

from lodestone.operators import facts, names
from lodestone.streaming import chat, sse

KEYS = ("trace", "kind", "number", "text", "n_events", "first_seq", "last_seq", "first_delta", "delta_bytes", "status")


def plain(rows):
    return sorted((*[r[k] for k in KEYS], tuple(sorted((r["facts"] or {}).items()))) for r in (x.asDict() for x in rows))


def plain_key(row):
    return tuple(str(x) for x in row)


def said(rng, n):
    frames = ['event: start\r\ndata: {"metadata": {"model": "m1", "reason": null}}\r\n\r\n', "data: not json\n\n", "data: [1]\n\n"]
    for i in range(n):
        frames.append(f"event: delta\ndata: {json.dumps({'text': rng.choice(['ab', 'é', '', 'longer text', '日本'])})}\n\n")
        if rng.random() < 0.2:
            frames.append('event: stage\ndata: {"label": "x", "metadata": {"model": null, "project_id": "p%d"}}\n\n' % i)
    frames += rng.choice([['event: done\ndata: {"metadata": {"reason": "ok"}}\n\n', "event: cancelled\ndata: {}\n\n"], ["event: cancelled\ndata: {}\n\n", 'event: error\ndata: {"code": "x"}\n\n'], ["event: delta\ndata: {"], []])
    return "".join(frames)


def test_chat_stream_over_a_restart(spark, tmp_path):
    rng = random.Random(6)
    files = [[] for _ in range(6)]
    for t in range(12):
        text = said(rng, rng.randint(0, 15))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(5))
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True)):
            files[i].append({"trace": f"t{t}", "ts": f"2024-01-01 00:0{i}:00", "seq": i, "piece": text[a:b]})
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def put(i, rows):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))

    schema = "trace string, ts timestamp, seq long, piece string"

    def go_on():
        stream = chat.chat_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), 12, "30 minutes")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination()

    for i in range(3):
        put(i, files[i])
    go_on()  # stops in the middle of frames
    for i in range(3, 6):
        put(i, files[i])
    go_on()
    put(6, [{"trace": "late", "ts": "2024-01-01 02:00:00", "seq": 0, "piece": ""}])
    go_on()  # the watermark passes all idle traces
    put(7, [{"trace": "later", "ts": "2024-01-01 02:00:01", "seq": 0, "piece": ""}])
    go_on()
    table = spark.read.schema(schema).json(str(folder)).where("trace not in ('late', 'later')")
    batch = chat.chat_batch(table, 12).collect()
    got = [r for r in spark.read.parquet(out).collect() if r.trace not in ("late", "later")]
    assert sorted(plain(got), key=plain_key) == sorted(plain(batch), key=plain_key)
    assert {r.status for r in batch if r.kind == "lifecycle"} >= {"completed", "failed", "running"}
    assert len([r for r in batch if r.kind == "lifecycle"]) == 12
    # the relational forms agree on frames and batches
    whole = table.groupBy("trace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("text"))
    events = sse.frames(whole).select("trace", "seq", F.col("event").alias("kind"), F.coalesce(F.get_json_object("data", "$.text"), F.lit("")).alias("text"))
    expected = sorted((r.trace, r.batch, r.text) for r in sse.batch_deltas(events, 12).collect() if r.text)
    assert sorted((r.trace, r.number, r.text) for r in batch if r.kind == "batch") == expected


def test_chat_stream_forgets_endless_frames():
    held = chat.Trace()
    assert list(held.take("data: " + "x" * (chat.MAX_REST + 10))) == [] and held.rest == ""


MODULES = {
    "pkg/__init__.py": "from .core import run as go\nfrom .deep import helper\nfrom . import core as engine\n",
    "pkg/core.py": "def run():\n    return step()\n\ndef step():\n    return 1\n\nclass Engine:\n    def start(self):\n        return self.stop()\n    def stop(self):\n        return run()\n",
    "pkg/deep/__init__.py": "from .impl import helper\nfrom ..core import Engine as Machine\n",
    "pkg/deep/impl.py": "def helper():\n    pass\n",
    "app/main.py": "import pkg\nimport pkg.core as c\nfrom pkg import go, helper as h\nfrom pkg.deep import Machine\nfrom loop.a import x\nfrom other import gone\n\ndef main():\n    go()\n    h()\n    pkg.go()\n    pkg.engine.step()\n    c.run()\n    Machine.start()\n    x()\n    gone()\n    print()\n    pkg.deep.impl.helper()\n",
    "loop/a.py": "from .b import x\n", "loop/b.py": "from .a import x\n",
    "two/a.py": "from pkg.core import run as f\nfrom pkg.core import step as f\n\nf()\n",
}


def test_names_across_modules(spark):
    files = spark.createDataFrame(list(MODULES.items()), "path string, text string")
    found = facts.python_facts(files)
    got = {(r.path, r.called): (r.target_path, r.target_symbol) for r in names.resolved_calls(found).collect()}
    run, helper = ("pkg/core.py", "run"), ("pkg/deep/impl.py", "helper")
    main = {c: t for (p, c), t in got.items() if p == "app/main.py"}
    assert main == {"go": run, "h": helper, "pkg.go": run, "pkg.engine.step": ("pkg/core.py", "step"), "c.run": run, "Machine.start": ("pkg/core.py", "Engine.start"), "x": (None, None), "gone": (None, None), "print": (None, None), "pkg.deep.impl.helper": helper}
    assert got["pkg/core.py", "self.stop"] == ("pkg/core.py", "Engine.stop") and got["pkg/core.py", "run"] == run and got["pkg/core.py", "step"] == ("pkg/core.py", "step")
    assert got["two/a.py", "f"] == (None, None)


def test_two_files_of_one_module_are_ambiguous(spark):
    rows = [("m.py", "def f(): pass\n"), ("m/__init__.py", "def f(): pass\n"), ("u.py", "from m import f\nf()\n")]
    got = names.resolved_calls(facts.python_facts(spark.createDataFrame(rows, "path string, text string"))).collect()
    assert [(r.called, r.target_path) for r in got] == [("f", None)]
