from ferrywork.llm import p4_encoding as P

CLEAN = ["Österlund cohort – naïve façade", "“three-point” hold at 37 °C", "≥ 59 µmol/L of bile", "L’équipe a relevé des lésions après réévaluation", "Größere Gefäße dürfen übersichtlich", "¿Qué estructura cruza por detrás?", "Пузырный проток необходимо выделить", "the plain words stay as they are"]


def damaged(text, kind):
    if kind == "twice":
        return damaged(damaged(text, "cp1252"), "cp1252")
    if kind == "escape":
        return "".join(c if c.isascii() else "".join(f"&#{b};" for b in c.encode()) for c in text)
    return "".join(P._DECODE[kind][b] for b in text.encode("utf-8"))


def table(spark, extra):
    rows = [(f"c{i}_{k}", t, f"[Document: x]\n{t}") for i, t in enumerate(CLEAN) for k in range(40)]
    return spark.createDataFrame([*rows, *extra], "chunk_id string, text string, contextualized_text string")


def test_every_chain_comes_back(spark):
    kinds = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "twice", "escape"]
    extra = [(f"{k}_{i}", damaged(t, k), f"[Document: x]\n{t}") for k in kinds for i, t in enumerate(CLEAN[:6])]
    got = {(r.id, r.field_name): r for r in P.restore_encoding(table(spark, extra)).collect()}
    missing = [x[0] for x in extra if (x[0], "text") not in got]
    wrong = [x[0] for x in extra if (x[0], "text") in got and got[x[0], "text"].restored != CLEAN[int(x[0][-1])]]
    assert not missing and not wrong
    assert all(r.damage == "restorable" for r in got.values()) and all(k[0] in {x[0] for x in extra} and k[1] == "text" for k in got)


def test_lossy_and_sound_fields(spark):
    extra = [
        ("q", "a na?ve view", None), ("r", "lost � sign", None), ("s", None, "[Document: x]\nS?ovelo ? none"), ("t", "Is it so? Yes.", "What?\nNo"), ("u", "", ""), ("v", None, None), ("w", "é" * 20000, None), ("t", "Is it so? Yes.", "What?\nNo"),
    ]
    got = {(r.id, r.field_name): r.damage for r in P.restore_encoding(table(spark, extra)).collect()}
    assert got == {("q", "text"): "lossy", ("r", "text"): "lossy", ("s", "contextualized_text"): "lossy"}


def test_empty_table_and_clashing_columns(spark):
    df = table(spark, [("x", damaged(CLEAN[0], "cp1252"), None)]).selectExpr("*", "'1' as id", "'2' as damage", "'3' as ctx", "4 as n")
    assert [(r.chunk_id, r.field_name, r.damage) for r in P.found(df).collect()] == [("x", "text", "restorable")]
    assert P.found(df.limit(0)).count() == 0
