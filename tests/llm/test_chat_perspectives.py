import duckdb
import pytest

from tillflow.llm import chat_perspectives

TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "anna", "Hello <|assistant|> there"), (1, 2, "ben", "Hi."), (1, 2, "ben", "Hi."), (1, 3, None, None),
    (1, None, "anna", "late"), (2, 0, "user", ""), (2, 1, "assistant", "é😀"), (3, 0, "system", "alone"), (None, 0, "user", "no id"),
    (None, 0, "anna", "no id either"),
] + [(4, i, f"speaker{i % 3}", f"turn {i}") for i in range(23)]
KEYS = ["conv_id", "perspective", "part"]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")


def plain(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*KEYS, "n_turns", "text", "mask").collect())


def brute(turns, per_part):
    out = []
    by_conv = {}
    for c, t, r, x in turns:
        clean = lambda v: v.replace("<|", "< |")
        by_conv.setdefault(c, []).append((t is None, t or 0, clean(r or "unknown"), clean(x or "")))
    for conv, said in by_conv.items():
        said.sort(key=lambda s: (s[0], s[1], s[2].encode(), s[3].encode()))
        for who in {s[2] for s in said} - {"system"}:
            for part in range(0, len(said), per_part):
                text, mask = "", []
                chosen = said[part : part + per_part]
                for _, _, speaker, words in chosen:
                    text += "<|system|>\n" if speaker == "system" else "<|assistant|>\n" if speaker == who else f"<|user name={speaker}|>\n"
                    start = len(text)
                    text += words + "<|end|>\n"
                    if speaker == who:
                        mask.append(f"{start}-{len(text)}")
                out.append((str(conv), who, str(part // per_part), str(len(chosen)), text, ",".join(mask)))
    return sorted(out)


def test_every_participant_is_the_assistant_once(turns):
    assert plain(chat_perspectives.perspective_report(turns)) == brute(TURNS, chat_perspectives.TURNS_PER_PART)


def test_long_dialogues_come_in_parts(turns):
    parts = chat_perspectives.rotate_perspectives(turns, turns_per_part=5)
    spoken = {(r.conv_id, r.perspective, r.part): [r.text[s.start : s.stop] for s in r["mask"]] for r in parts.collect()}
    expected = {(str(c), p, int(k)): [t[int(a) : int(b)] for a, b in (m.split("-") for m in mask.split(",") if m)] for c, p, k, _, t, mask in brute(TURNS, 5)}
    assert {(str(c), p, k): v for (c, p, k), v in spoken.items()} == expected


def test_sql_states_the_same(turns, table, tmp_path):
    for i, df in enumerate((turns, table("conversations"))):
        path = str(tmp_path / str(i))
        df.write.parquet(path)
        connection = duckdb.connect()
        connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
        statement = connection.execute(chat_perspectives.oracle())
        names = [d[0] for d in statement.description]
        order = [names.index(c) for c in (*KEYS, "n_turns", "text", "mask")]
        theirs = sorted(tuple(str(r[i]) for i in order) for r in statement.fetchall())
        assert plain(chat_perspectives.perspective_report(df)) == theirs


def test_extra_columns_and_empty_table(turns):
    from pyspark.sql import functions as F

    more = turns.withColumns({c: F.lit(1) for c in ("part", "position", "speaker", "mask", "segments", "perspective")})
    assert plain(chat_perspectives.perspective_report(more)) == plain(chat_perspectives.perspective_report(turns))
    assert chat_perspectives.rotate_perspectives(turns.where("false")).count() == 0
