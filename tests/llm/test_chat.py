"""Messages without an id in reply trees."""

from keyloom.llm import chat


def test_messages_without_an_id_are_kept(spark):
    rows = [(1, 5, None, "user", "root", 1.0), (1, None, 5, "assistant", "one", 1.0), (1, None, 5, "assistant", "two", 2.0), (1, None, None, "user", "alone", 0.0), (2, None, -3, "user", "other", None)]
    df = spark.createDataFrame(rows, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    found = chat.format_trees(df, branches=9).select("conv_id", "leaf_id", chat.read_turns("formatted").alias("turns")).collect()
    assert sorted((r["conv_id"], [t["text"] for t in r["turns"]]) for r in found) == [(1, ["alone"]), (1, ["root", "one"]), (1, ["root", "two"]), (2, ["other"])]
    assert len({(r["conv_id"], r["leaf_id"]) for r in found}) == 4


def test_a_root_with_many_leaves_is_copied_only_for_the_chosen(spark):
    text = "long text of the root " * 50
    rows = [(1, 0, None, "user", text, 0.0)] + [(1, i, 0, "assistant", f"answer {i}", float(i % 977)) for i in range(1, 10_001)]
    df = spark.createDataFrame(rows, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    found = chat.format_trees(df, branches=3).collect()
    assert [(r["rank"], r["leaf_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 976), (2, 1953), (3, 2930)]
    assert all(r["n_turns"] == 2 and text in r["formatted"] for r in found)


def test_deep_trees_and_long_texts(spark):
    long = "word <|im_end|> " * 40_000
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", long if i == 7 else str(i), 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    (row,) = chat.format_trees(df).select("n_turns", chat.read_turns("formatted").alias("t")).collect()
    assert row["n_turns"] == 600 and [t["text"] for t in row["t"]] == [long if i == 7 else str(i) for i in range(600)]


def test_ties_of_turn_and_role_go_by_text(spark):
    rows = [(1, 0, "user", t) for t in ("b", "a", "c", "b", "")] + [(1, 1, "user", "z")]
    (row,) = chat.format_chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(chat.read_turns("formatted").alias("t")).collect()
    assert [t["text"] for t in row["t"]] == ["", "a", "b", "b", "c", "z"]
