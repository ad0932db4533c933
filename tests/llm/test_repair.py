import functools
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from cohortlens.llm import repair
from tests.llm.helpers import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")
END = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """First fault of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        found = END.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else
                   "truncated" if found[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_repair(rows, most=2):
    """(cost, audit, lines) by trying all edits with up to ``most`` inserts in a gap."""
    kinds = faults(rows)
    gaps = [list(g) for n in range(most + 1) for g in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    per_row = []
    for (role, text), f in zip(rows, kinds, strict=True):
        extra = 5 if f == "truncated" else 0
        some = [("D", 2, None)]
        if f not in ("blank", "duplicate"):
            some += [("K", extra, (role, text)), ("R", 1 + extra, ("user", text)), ("R", 1 + extra, ("assistant", text))]
        per_row.append(some)
    for edits in itertools.product(*per_row):
        for adds in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 5 * sum(map(len, adds))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for add, e in itertools.zip_longest(adds, edits):
                audit += "I" * len(add) + (e[0] if e else "")
                lines += [(r, "") for r in add] + ([e[2]] if e and e[2] else [])
            if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def plain_repair(rows):
    """The same by a memo over (row, state) of whole (cost, audit, lines), any length."""
    kinds = faults(rows)

    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(i, p, adds):
        got = [(0, "", ())] if i == len(rows) and p in (0, 3) else []

        def more(cost, c, line, rest):
            got.append((cost + rest[0], c + rest[1], ((line,) if line else ()) + rest[2]))

        if adds < 3:
            for role in ("user", "assistant"):
                if (p, role[0]) in step:
                    more(5, "I", (role, ""), best(i, step[p, role[0]], adds + 1))
        if i < len(rows):
            role, text = rows[i]
            extra = 5 if kinds[i] == "truncated" else 0
            more(2, "D", None, best(i + 1, p, 0))
            if kinds[i] not in ("blank", "duplicate"):
                if (p, role[:1]) in step:
                    more(extra, "K", (role, text), best(i + 1, step[p, role[:1]], 0))
                for to in ("user", "assistant"):
                    if (p, to[0]) in step:
                        more(1 + extra, "R", (to, text), best(i + 1, step[p, to[0]], 0))
        return min(got, default=(10**9, "~", ()))

    return best(0, 0, 0)


def sha(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode("utf-8", "surrogatepass")).hexdigest()


def wanted(rows):
    """Rows of the query for (conv_id, turn, role, text) rows."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, left in by.items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in left if t is not None}
        pairs = [(r, t) for _, r, t in left]
        f = faults(pairs)
        cost, audit, lines = plain_repair(pairs)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("blank"), f.count("duplicate"),
                     f.count("truncated"), sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False)),
                     cost, audit, sha(lines))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def as_rows(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query_equals_plain_programming_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repair.op12(spark, SF)
    assert got.columns[0] == "conv_id" and as_rows(got) == wanted(rows) and got.count() == len({r[0] for r in rows})


def _audits(rows):
    kinds = faults(rows)
    symbols = "".join("b" if f == "blank" else "d" if f == "duplicate" else
                      repair._initial(r[:1]).upper() if f == "truncated" else repair._initial(r[:1])
                      for (r, _), f in zip(rows, kinds, strict=True))
    return repair.audit(symbols)


def test_audits_equal_trying_every_edit():
    texts = ["one.", "two!", "cut", " "]
    for n in (0, 1, 2):
        for rows in itertools.product([(r, t) for r in ("system", "user", "assistant", "tool", "") for t in texts], repeat=n):
            want = every_repair(list(rows))
            assert _audits(list(rows)) == want[:2] and plain_repair(list(rows))[:2] == want[:2]
    rng = np.random.default_rng(1)
    for _ in range(12):
        rows = [(("system", "user", "assistant", "tool")[rng.integers(0, 4)], texts[rng.integers(0, 4)]) for _ in range(3)]
        assert _audits(rows) == every_repair(rows, 1)[:2] == plain_repair(rows)[:2]


def test_long_runs_equal_plain_programming():
    rng = np.random.default_rng(2)
    for _ in range(60):
        rows, k = [], 0
        for _ in range(rng.integers(1, 6)):
            role, cut = ("system", "user", "assistant", "x")[rng.integers(0, 4)], rng.integers(0, 3) == 0
            for _ in range(rng.integers(1, 9)):
                k += 1
                rows.append((role, f"text {k}" + ("" if cut else ".")))
        assert _audits(rows) == plain_repair(rows)[:2]


def test_run_length_powers_advance_like_single_rows():
    for symbol in "suaoSUAObd":
        w = repair.LAST
        for n in range(1, 40):
            w = repair._apply(repair.power(symbol, 0), w)
            assert repair.before((symbol, n), repair.LAST) == w
            assert repair._apply(repair.matrix([(symbol, n)]), repair.LAST) == w
    assert repair.collapse("uuaab") == [("u", 2), ("a", 2), ("b", 1)] and repair.collapse("") == []
    assert repair.audit("u" * 100_000)[1].count("R") == 50_000


ODD = [
    (1, 0, "system", "Be kind."), (1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, 5, "assistant", "cut off"),
    (2, None, None, None), (2, None, "user", "No turn."), (2, 1, "assistant", ""), (2, 1, "", "empty role."),
    (3, None, "user", None), (4, 7, "user", "long " * 20_000 + "."), (4, 8, "assistant", "ok \t\n"), (4, 9, "assistant", "fin!"),
    (None, 1, "user", "No id."), (None, 2, "assistant", "Yes."), (None, None, "user", "x"),
    (5, 0, "tool", "T\x85"), (5, 1, "user", "naïve 東京 \U0001f600."), (5, 2, "user", "Again?"), (5, 3, "system", "Late."),
]


@pytest.mark.parametrize("piece", [1, 2, 3, 4096])
def test_odd_rows_and_long_conversations_in_pieces(spark, monkeypatch, tmp_path, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = np.random.default_rng(piece)
    rows = ODD + [(6, t, ("system", "user", "assistant", "tool")[rng.integers(0, 4)],
                   ("a.", "b!", "cut", f"{t}.", f"{t}?", "")[rng.integers(0, 6)]) for t in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    for clash in ("conv", "piece", "rank", "state", "kind", "first", "same", "copy"):
        from pyspark.sql import functions as F

        df = df.withColumn(clash, F.lit("x"))
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert as_rows(repair.op12(spark, str(tmp_path))) == wanted(rows)


def test_nothing_left_and_empty_tables(spark, tmp_path):
    gone = [(c, t, "user", "x.") for c in range(400) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    spark.createDataFrame(gone, SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = as_rows(repair.op12(spark, f"{tmp_path}/a"))
    assert len(got) == 3 and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert repair.op12(spark, f"{tmp_path}/b").count() == 0
