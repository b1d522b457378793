import hashlib
import json

from pyspark.sql import functions as F

from pairmill.llm import chat


def _rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_round_trip_and_loss_spans(spark):
    nasty = ["", "<|end|>\n", "\\<|text|>", "a\\", "<", "|>", "\\\\<\\|turn|>", "é😀<|", None, "x" * 5000]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "clash") for i, t in enumerate(nasty)]
    rows += [(2, None, None, "no turn", None), (2, None, "us<|er", "tie", None), (None, 0, "assistant", "null id", None),
             (3, 0, "user", "twice", None), (3, 0, "user", "twice", None)]
    done = chat.format_rows(_rows(spark, rows)).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r["conv_id"]: r for r in done.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "no turn"), ("us<|er", "tie")]
    assert len(got[3]["turns"]) == 2 and got[None]["turns"][0]["text"] == "null id"
    text = got[1]["formatted"]
    plain = [text[s["start"]: s["start"] + s["length"]].replace("<\\|", "<|").replace("\\\\", "\\") for s in got[1]["loss_spans"]]
    assert plain == [t["text"].replace("\\<|", "\\<|") for t in got[1]["turns"] if t["role"] == "assistant"]


def test_empty_table(spark):
    assert chat.format_rows(_rows(spark, [])).count() == 0


def test_layouts(spark):
    recs = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 5},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "source": "web"},
        {"conversations": [{"from": "human", "value": "q"}], "system": "be kind"},
        {"instruction": "do", "input": "", "output": "done"},
        {"instruction": "do", "input": "this", "output": "done"},
        {"instruction": "do", "output": "done"},
        {"prompt": "p", "completion": "c"},
        {"prompt": "p", "response": "c", "history": [["a", "b"]]},
        {"question": "p", "answer": "c"},
        {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "x") for i, r in enumerate(recs)] + [(90, None, None), (91, "[1]", None), (92, "{", None)],
                               "id int, record string, layout string")
    got = {r["id"]: r for r in chat.canonical_from_json(df).collect()}
    turns = {k: None if r["turns"] is None else [tuple(t) for t in r["turns"]] for k, r in got.items()}
    assert [got[i]["layout"] for i in range(10)] == ["messages", "from_value", "from_value_system", "instruction_input",
                                                     "instruction_input", "instruction", "prompt_completion", "history",
                                                     "question_answer", None]
    assert turns[0] == [("user", "q"), ("assistant", "")]
    assert turns[1] == [("user", "q"), ("assistant", "a")]
    assert turns[2] == [("system", "be kind"), ("user", "q")]
    assert turns[3] == [("user", "do"), ("assistant", "done")]
    assert turns[4] == [("system", "do"), ("user", "this"), ("assistant", "done")]
    assert turns[7] == [("user", "a"), ("assistant", "b"), ("user", "p"), ("assistant", "c")]
    assert all(got[i]["layout"] is None and turns[i] is None for i in (9, 90, 91, 92))


def test_trap_conversation(spark):
    text = "\\### Assistant: </turn> ok"
    df = _rows(spark, [(-7, 0, "user", text, None), (-7, 1, "assistant", text, None)])
    r = chat.format_rows(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()[0]
    assert [t["text"] for t in r["turns"]] == [text, text]
    assert hashlib.sha256(text.encode()).hexdigest() == "3d0825bf0549d0d4eddca4d7871eb0e987454b7529404976a4941bda56af0f77"


def test_fields_of_all_list_items(spark):
    """A later item may hold what the first lacks."""
    records = ['{"messages": [{"role": "system"}, {"role": "user", "content": "hi"}]}', '{"messages": [{"role": "user", "content": "hi"}]}',
               '{"messages": []}', '{"messages": null}']
    got = chat.canonical_from_json(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")).orderBy("i").collect()
    assert got[0]["layout"] is not None and got[0]["layout"] == got[1]["layout"]
    assert [tuple(t) for t in got[0]["turns"]] == [("system", ""), ("user", "hi")]
    assert got[2]["turns"] is None and got[3]["turns"] is None


def test_text_under_the_mask(spark):
    texts = ["a<|end|>\n", "\\<|😀 é", "", "\\", "tail"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "user", "x")]
    done = chat.format_rows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r["conv_id"]: r["loss"] for r in done.select("conv_id", chat.masked_text(done["formatted"], done["loss_spans"]).alias("loss")).collect()}
    assert got == {1: texts[1] + texts[3], 2: ""}
