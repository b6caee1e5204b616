"""Three-provider log trees against turns made by hand."""

import json

from hearthlog.operators import clean, ingest
from hearthlog.sources import logs


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def rows(df):
    return [(r.msg_index, r.role, r.text) for r in df.orderBy("file", "msg_index").collect()]


def test_codex(spark, tmp_path):
    put(
        tmp_path / "a/s.jsonl",
        "{broken", "", "[1]",
        {"timestamp": "2024-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hello"}, {"type": "image"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell_command", "arguments": json.dumps({"command": "ls -l"})}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "other", "arguments": "{}"}},
        {"type": "event_msg", "payload": {"type": "agent_message", "message": "done"}},
        {"type": "response_item", "payload": {"type": "message", "content": "plain"}},
    )
    assert rows(logs.read_codex_turns(spark, str(tmp_path))) == [(1, "user", "hello"), (2, "cmd", "ls -l"), (3, "assistant", "done"), (4, "assistant", "plain")]
    raw = logs.read_raw_turns(spark, str(tmp_path), "codex")
    assert [r[1] for r in rows(raw)] == ["user", "assistant"]
    assert raw.orderBy("msg_index").first().ts.year == 2024


def test_claude(spark, tmp_path):
    put(
        tmp_path / "p/s.jsonl",
        {"message": {"role": "assistant", "content": [{"type": "text", "text": "first"}, {"type": "tool_use", "name": "Bash", "input": {"cmd": "a"}}, {"type": "tool_use", "name": "x", "input": {"command": "b"}}, "odd"]}},
        {"message": {"role": "user", "content": "[1,2] text"}},
        {"message": {"role": "system", "content": "no"}},
        {"role": "user", "content": "top"},
        {"role": "system", "content": "not said at the top"},
        {"message": {"role": "assistant", "content": []}, "role": "user", "content": "beside an empty message"},
        {"message": {"content": "of the line's type"}, "type": "summary"},
    )
    assert (3, "assistant", "first\nBash\nx") in rows(logs.read_claude_turns(spark, str(tmp_path), include_tools=True))
    assert [r[1:] for r in rows(logs.read_raw_turns(spark, str(tmp_path), "claude"))] == [("assistant", "first"), ("user", "[1,2] text"), ("system", "no"), ("user", "top"), ("user", "beside an empty message"), ("summary", "of the line's type")]
    assert rows(logs.read_claude_turns(spark, str(tmp_path))) == [(1, "cmd", "a"), (2, "cmd", "b"), (3, "assistant", "first"), (4, "user", "[1,2] text"), (5, "user", "top")]


def test_gemini(spark, tmp_path):
    put(tmp_path / "chats/s.json", {"messages": [{"type": "user", "content": "q"}, {"type": "gemini", "content": "a", "toolCalls": [{"name": "run_shell", "args": {"command": "pwd"}, "resultDisplay": "shown", "result": [{"x": {"output": "deep"}}]}]}, {"type": "info", "content": "i"}, 3]})
    put(tmp_path / "chats/bad.json", "{")
    assert rows(logs.read_gemini_turns(spark, str(tmp_path))) == [(1, "user", "q"), (2, "assistant", "a"), (3, "cmd", "pwd")]
    assert rows(logs.read_gemini_turns(spark, str(tmp_path), include_tools=True))[-1] == (4, "tool", "shown")
    assert rows(logs.read_raw_turns(spark, str(tmp_path), "gemini")) == [(1, "user", "q"), (2, "assistant", "a\nshown\ndeep"), (3, "info", "i")]


def test_inventory(spark, tmp_path):
    put(tmp_path / "c/x.jsonl", "{}")
    put(tmp_path / "g/chats/y.json", "{}")
    put(tmp_path / "g/z.json", "{}")
    got = logs.session_inventory(spark, {"codex": str(tmp_path / "c"), "gemini": str(tmp_path / "g"), "claude": str(tmp_path / "none")})
    assert sorted((r.provider, r.path.rsplit("/", 1)[1]) for r in got.collect()) == [("codex", "x.jsonl"), ("gemini", "y.json")]


def test_clean(spark):
    data = [("claude", "f", 1, "user", "  a  \r\n\n"), ("claude", "f", 2, "user", "<command-name>x"), ("claude", "f", 3, "assistant", "<system-reminder>x</system-reminder>"), ("claude", "f", 4, "assistant", "k<my-hook>1\n2</a-caveat>\n\n\n\nl"), ("claude", "f", 5, "user", None)]
    df = spark.createDataFrame(data, "provider string, file string, msg_index long, role string, text string")
    assert rows(clean.clean_turns(df)) == [(1, "user", "a"), (2, "assistant", "k\n\nl")]


def test_inline_commands(spark):
    text = "x\n```bash\n$ ls\n\npwd\n```\n> ls\n$ make\n```python\nno\n```"
    df = spark.createDataFrame([("p", "f", 1, "user", text)], "provider string, file string, msg_index long, role string, text string")
    assert [r.command for r in clean.extract_inline_commands(df).orderBy("ordinal").collect()] == ["ls", "pwd", "make"]


def test_ingest_twice_is_once(spark):
    files = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "path string, m long, size long").selectExpr("path", "timestamp_seconds(m) AS mtime", "size")
    read = lambda f: f.selectExpr("path AS file", "1L AS msg_index", "path AS text")
    empty_state = spark.createDataFrame([], "file string, mtime timestamp, size long, msg_index long")
    none = spark.createDataFrame([], "file string, msg_index long, text string")
    turns, state = ingest.incremental_ingest(files, empty_state, none, read)
    again, _ = ingest.incremental_ingest(files, state, turns, read)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, turns.collect())) == [("a", 1, "a"), ("b", 1, "b")]
    assert ingest.changed_files(files, state).isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from hearthlog.streaming.append import stream_turns

    put(tmp_path / "in/a.txt", "one", "", "two")
    parse = lambda b: b.select("file", "line", F.lit("user").alias("role"), F.col("value").alias("text"))
    for more in ("", "in/b.txt"):
        if more:
            put(tmp_path / more, "three")
        stream_turns(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), parse).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("msg_index", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "one"), (1, "three"), (2, "two")]


def test_raw_gemini_results(spark, tmp_path):
    """Strings at any depth, in the order of the text and not of their keys, without Python workers."""
    deep = {"text": "bottom"}
    for i in range(120):
        deep = {"x": [deep, {"output": str(i)}]}
    mixed = {"z": {"output": "first"}, "a": [{"content": "second [\"{", "output": None}, "loose", {"text": {"output": "third\\"}}], "text": "last", "content": 7}
    said = [
        {"type": "model", "content": " kept \n", "toolCalls": [{"result": mixed, "resultDisplay": "shown"}, {"resultDisplay": {"no": "string"}}, 5, None]},
        {"content": [{"type": "text", "text": "one"}, {"text": "two"}, 3], "toolCalls": [{"result": "{\"text\": \"a string, no object\"}"}]},
        {"type": "user", "content": "", "toolCalls": {"result": mixed}},
        {"type": "tool", "toolCalls": [{"result": deep}]},
        "text",
        None,
    ]
    put(tmp_path / "chats/s.json", {"x": 1, "messages": said})
    put(tmp_path / "chats/none.json", {"messages": None})
    (tmp_path / "chats/broken.json").write_text('{"messages": [{"type": "user", "content": "x"}')
    (tmp_path / "chats/empty.json").write_text("")
    got = logs.read_raw_turns(spark, str(tmp_path), "gemini")
    deepest = "\n".join(["bottom", *map(str, range(120))])
    assert rows(got) == [(1, "assistant", "kept \n\nshown\nfirst\nsecond [\"{\nthird\\\nlast"), (2, "", "one\ntwo"), (3, "tool", deepest)]
    assert "Python" not in got._jdf.queryExecution().toString() and "InPandas" not in got._jdf.queryExecution().toString()
