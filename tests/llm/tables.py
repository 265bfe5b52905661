"""Small tables with awkward rows, written where the queries read them."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

ITEM = " ".join(f"probe{k} item{k % 3}" for k in range(12)) + "."
PROSE = [" ".join(r.choice(["the", "of", "river", "\u00c9a", "gr\u00f6\u00dfe", f"w{r.randrange(300)}", f"v{r.randrange(300)}"]) for _ in range(90 + k)) for k, r in enumerate(map(random.Random, range(12)))]


def _edited(text: str, every: int) -> str:
    return " ".join("swap" if j % every == every - 1 else w for j, w in enumerate(text.split(" ")))


def documents() -> list[dict]:
    texts: list[str | None] = [
        None, "", " \t\n\x0b\x0c\r ", "one", "one two three", "one two  three",
        *PROSE, PROSE[0], PROSE[0], PROSE[0] + "\n", _edited(PROSE[1], 40), _edited(PROSE[1], 45), _edited(PROSE[2], 3),
        PROSE[3] + " " + ITEM.upper() + " " + PROSE[4], ITEM,
        "line a b\nline a b\n\n \nline a b\nother", "### ||| %%% " * 30,
        "mail a.b@c.example.org, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111 call +1 (555) 010-0199 x 1.2.3.4.5 a@b@c.d.e_f@g.hh",
        "iban GB82 WEST 1234 5698 7654 32 bank; ssn 219-09-9999", "0" * 5000, "+1" + "(" * 3000, "a" * 4000 + "@" + "b" * 4000,
        "\U0001f600 e\u0301 \u00a0x\u2003y \x1c z <|endoftext|> tail  ", "long " + " ".join(f"t{j % 997}" for j in range(60_000)), "x" * 300_000,
    ]
    rows = [{"doc_id": k, "text": t, "lang": "en", "source": f"s{k % 4}", "n_chars": len(t or "")} for k, t in enumerate(texts)]
    rows[3]["source"] = rows[7]["source"] = None
    rows[8]["lang"] = rows[8]["n_chars"] = None
    rows.append({"doc_id": None, "text": PROSE[5] + " no id", "lang": None, "source": "ß", "n_chars": None})
    rows.append(dict(rows[9]))
    rows.append(dict(rows[9]))
    rows.append({**rows[10], "text": PROSE[6] + " same id, other text"})
    return rows


def labels() -> list[dict]:
    rows = [{"doc_id": k, "quality": int(k % 5 > 0), "toxic": 0} for k in range(40)]
    return rows + [{"doc_id": None, "quality": 1, "toxic": None}, {"doc_id": 2, "quality": None, "toxic": 0}, {"doc_id": 1, "quality": 0, "toxic": 1}]


def benchmark() -> list[dict]:
    return [{"item_id": 0, "text": ITEM}, {"item_id": 1, "text": None}, {"item_id": 2, "text": ""}, {"item_id": 3, "text": "three one"}, {"item_id": 4, "text": ITEM}, {"item_id": None, "text": PROSE[7]}]


def pages() -> list[dict]:
    urls = [
        None, "", "no scheme", "http://", "https://COM/", "https://com", "http://A.Example.COM/en/1?x=/fr/", "http://www.example.com/en/2#a", "http://notexample.com/en/",
        "http://example.com/en", "ftp://x.net/es/1", "http://net/fr/", "http://internet/es/", "http://u.net?x=1://y.com/", "http://a.org/p/q/r.html?a=1&b=2&&c", "http://" + "z" * 50_000 + ".net/es/",
        "x\n://h.com/\npath", "http://a.net/es/1", "http://b.com/de/2", "http://ÄÖ.com/ü", "a://b://c.com/",
    ]
    rows = [{"page_id": k, "url": u, "html": None} for k, u in enumerate(urls)]
    return rows + [{"page_id": None, "url": "http://a.org/1", "html": "x"}, dict(rows[6]), dict(rows[6])]


def conversations() -> list[dict]:
    said = [r"\### Assistant: </turn> ok", "", None, "a \\ b \\\\ </turn>### ", "<|endoftext|> ### x\n</turn>\n", "plain  text \U0001f600", "### ### ###"]
    rows = [{"conv_id": c, "turn": t, "role": ("system", "user", "assistant", "tool", "critic ### ", None)[(c + t) % 6], "text": said[(c * 3 + t) % len(said)]} for c in range(4) for t in range(6)]
    rows += [{"conv_id": None, "turn": 0, "role": "assistant", "text": "nobody"}, {"conv_id": 9, "turn": None, "role": "user", "text": "b"}, {"conv_id": 9, "turn": None, "role": "user", "text": "a"}]
    return rows + [dict(rows[2]), dict(rows[2]), {"conv_id": 10, "turn": 1, "role": "assistant", "text": "word " * 50_000}]


SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    "conversations": pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
}
MAKE = {"documents": documents, "labels": labels, "benchmark": benchmark, "pages": pages, "conversations": conversations}
# Names that the operators use inside; as columns of a table they must do no harm.
CLASHING = ("size", "node", "class", "key", "kept", "spans", "score", "label", "position", "_text", "_id", "_doc", "hash", "words", "part", "rule", "ids", "start", "target")


def write(folder: str, empty: bool = False, clashing: bool = False) -> str:
    """All five tables as Parquet files below `folder`."""
    os.makedirs(folder, exist_ok=True)
    for name, schema in SCHEMAS.items():
        table = pa.Table.from_pylist([] if empty else MAKE[name](), schema)
        if clashing:
            for c in CLASHING:
                table = table.append_column(c, pa.array(["?"] * len(table), pa.string()))
        pq.write_table(table, f"{folder}/{name}.parquet")
    return folder
