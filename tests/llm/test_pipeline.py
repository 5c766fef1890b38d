import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import public_tokenizers
import regex
import test_op3
import test_op6
import test_op7
import test_op8
from tokenizers import Tokenizer

import corpus_pipeline
from quakeframe.llm import common, op5_langid, op6_pseudonyms, queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_in_order(spark):
    docs = common.table(spark, DIR, "documents")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.written(stage(spark, before, DIR), f"test-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        ids, had = Counter(r.doc_id for r in after.select("doc_id").collect()), {r.doc_id for r in before.select("doc_id").collect()}
        assert set(ids) <= had
        if k in (0, 1, 2):
            assert max(ids.values()) == 1
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "pseudonyms", "mixing", "best_fit_packing"]


def test_run_is_the_stages(spark):
    a = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(a.columns) and a.count() > 0


def test_rejected_and_empty_rows_pass_through(make, odd, spark):
    docs = make(odd)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, DIR), f"odd-{name}")
    assert docs.count() > 0
    empty = make([])
    for name, stage in corpus_pipeline.STAGES:
        empty = common.written(stage(spark, empty, DIR), f"none-{name}")
    assert empty.collect() == []


def test_registered_names():
    found = queries.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))
    assert op5_langid.op5_langid is found["op5_langid"]


def test_sql_of_operators(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DIR)
        cols = sorted(df.columns)
        got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
        r = con.execute(sql)
        names = [c[0] for c in r.description]
        assert got == sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), name


def plain_language(rows):
    """Documents with a letter; those without a language under the likeliest one, by all pieces' probabilities."""
    counts = defaultdict(Counter)
    for i, t, lang, *_ in rows:
        if lang is not None and t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(regex.findall(r"\p{L}+", t.lower()))
    pieces = op5_langid.pieces_of()
    names, p = op5_langid.learn(pieces, {k: dict(v) for k, v in counts.items() if v})
    out = []
    for i, t, lang, *rest in rows:
        words = regex.findall(r"\p{L}+", (t or "").lower())
        if words:
            score = sum(op5_langid.word_scores(pieces, p, [w], op5_langid.Fit().unknown)[0] for w in words)
            out.append((i, t, lang if lang is not None else names[int(np.argmax(score))], *rest))
    return out


def plain_near_duplicates(rows):
    """One row of each group: the smallest id of the text whose id is the group's class."""
    want = test_op3.brute([(r[0], r[1]) for r in rows])
    group = {t: min(g) for t, (_, _, g) in want.items()}
    best = {}
    for r in rows:
        own, _, _ = want[r[1] or ""]
        if own is not None and own == r[0]:
            g = group[r[1] or ""]
            if g not in best or r[0] < best[g][0]:
                best[g] = r
    return [best[g] for g in set(group.values()) if g in best], {g for g in group.values() if g not in best}


def plain_pseudonyms(rows):
    """Every match of the patterns, in Python's regular expressions, replaced by the rules."""
    key = op6_pseudonyms.PUBLIC_KEY
    own = {k: re.compile(p.replace("(?<four>", "(?P<four>").replace("(?<six>", "(?P<six>").replace("\\k<four>", "(?P=four)").replace("\\k<six>", "(?P=six)"), re.ASCII) for k, p in op6_pseudonyms.PATTERNS.items()}
    sha = lambda kind, v: hashlib.sha256(f"{key}:{kind}:{v}".encode()).hexdigest()[:16]

    def refilled(form, digits):
        it = iter(digits)
        return re.sub("[0-9]", lambda _: next(it), form)

    def new(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "secret":
            head = re.match("((?i:password|passwd|pwd|token|secret|api[_-]?key)[ \\t]{0,3}[=:][ \\t]{0,3}[\"']?)?", m).group()
            return f"{head}secret-{sha('secret', m[len(head):])}"
        if kind == "email":
            return f"user-{sha('email', m.lower())}@mail.invalid"
        if kind == "ip":
            o = [int(x) for x in m.split(".")]
            if max(o) > 255:
                return m
            a, b = test_op6.feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
            return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        if kind == "card":
            body = test_op6.permuted("card", d[:-1])
            last = next(c for c in "0123456789" if test_op6.luhn(body + c))
            return refilled(m, body + last) if test_op6.luhn(d) else m
        if kind == "phone":
            head, d = d[:-10], d[-10:]
            if head in ("", "1"):
                if d[0] in "01" or d[3] in "01":
                    return m
                a, b = test_op6.feistel("phone", int(d[:3]) - 200, (int(d[3:6]) - 200) * 10000 + int(d[6:]), 800, 8_000_000)
                return refilled(m, f"{head}{a + 200}{b + 2_000_000:07}")
            return refilled(m, head + test_op6.permuted("phone", d))
        if kind == "date":
            order = (0, 4, 6) if re.match("[0-9]{4}[^0-9]", m) else None
            for form in ["ymd"] if order else ["mdy", "dmy"]:
                y, mo, da = (d[:4], d[4:6], d[6:]) if form == "ymd" else (d[4:], d[:2], d[2:4]) if form == "mdy" else (d[4:], d[2:4], d[:2])
                try:
                    n = (date(int(y), int(mo), int(da)) - date(1700, 1, 1)).days
                except ValueError:
                    continue
                if not 0 <= n < op6_pseudonyms.DAYS_A * op6_pseudonyms.DAYS_B:
                    return m
                a, b = test_op6.feistel("date", n // 773, n % 773, 189, 773)
                v = date(1700, 1, 1) + timedelta(a * 773 + b)
                return refilled(m, {"ymd": f"{v:%Y%m%d}", "mdy": f"{v:%m%d%Y}", "dmy": f"{v:%d%m%Y}"}[form])
            return m
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return m
        a, b = test_op6.feistel("ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return refilled(m, f"{a + 1 + (a >= 665):03}{b // 9999 + 1:02}{b % 9999 + 1:04}")

    def changed(text):
        out, at = [], 0
        while text is not None:
            hits = [(m.start(), k, m) for k, (name, p) in enumerate(own.items()) if (m := p.search(text, at)) is not None]
            if not hits:
                return "".join([*out, text[at:]])
            _, k, m = min(hits, key=lambda h: h[:2])
            out += [text[at : m.start()], new(list(own)[k], m.group())]
            at = m.end()
        return text

    return [(r[0], changed(r[1]), *r[2:]) for r in rows]


def plain_mixture(rows):
    """Complete epochs, then the documents of the least keys up to what is left of a source's target."""
    size = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    totals = defaultdict(int)
    for r in rows:
        totals[r[3]] += size(r[1])
    target, out, seen = test_op8.target_of(totals), [], Counter()
    for source, total in totals.items():
        own = []
        for r in rows:
            if r[3] == source:
                t = r[1] or ""
                share = sum(map(len, regex.findall(r"[\p{L}\p{M}]+", t))) / len(t) if t else 0
                weight = max(0.25, float(Decimal(repr(share)).quantize(Decimal("0.0001"), ROUND_HALF_UP)))
                digest = hashlib.md5(t.encode()).hexdigest()
                seen[r[0], digest] += 1  # rows that agree in id and text are numbered
                known = ":".join(["mix-1", *([] if r[0] is None else [str(r[0])]), digest, str(seen[r[0], digest])])
                u = (int(hashlib.md5(known.encode()).hexdigest()[:8], 16) + 0.5) / 2**32
                own.append((-math.log(u) / weight, r[0], size(t), r))
        epochs = int(target[source] // total) if total else 0
        rest, upto = target[source] - epochs * total, 0
        for _, _, n, r in sorted(own, key=lambda x: x[:2]):
            upto += n
            more = upto <= rest or (upto - n < rest and upto - rest < rest - (upto - n))
            out += [r] * (epochs + more)
    return out


def test_stages_against_plain_python(spark, make):
    """All stages, one after the other, each on what the one before it gave."""
    docs = common.table(spark, DIR, "documents")
    rows = [tuple(r) for r in docs.collect()]
    text = "Paid with 4785 3805 9239 1139 on 1984-02-29, call +1 (743) 555-3824 or 123-45-6789, see 02/30/1999 and 31.12.1999. "
    more = [(10_000, text * 3, None, "src0", 9), (10_001, "x " + text * 3, "en", None, 9), (10_002, None, "en", "a", 0), (10_003, "12 345 -- 6", "de", "a", 9), (10_004, "der die das und ist nicht ein Haus", None, "b", 9)]
    rows += more
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = common.written(stages[0](spark, docs, DIR), "plain-1")
    first = plain_language(rows)
    assert Counter(map(tuple, one.collect())) == Counter(first) and len(first) < len(rows)
    two = common.written(stages[1](spark, one, DIR), "plain-2")
    second, unnamed = plain_near_duplicates(first)
    assert not unnamed and Counter(map(tuple, two.collect())) == Counter(second) and len(second) < len(first)
    three = common.written(stages[2](spark, two, DIR), "plain-3")
    third = plain_pseudonyms(second)
    assert Counter(map(tuple, three.collect())) == Counter(third) and sum(a != b for a, b in zip(second, third, strict=True)) > 2
    four = common.written(stages[3](spark, three, DIR), "plain-4")
    fourth = plain_mixture(third)
    assert Counter(map(tuple, four.collect())) == Counter(fourth)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n, least = test_op7.check(fourth, stages[4](spark, four, DIR).collect(), lambda text: t.encode(text or "", add_special_tokens=False).ids + [2])
    assert n <= least + 1
