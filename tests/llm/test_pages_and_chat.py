import base64
import hashlib
import random
import re

import duckdb
import pytest

from lodestrata.llm import chat, url_filter, warc


def test_urls_against_plain_rules(spark):
    r = random.Random(2)
    hosts = ["net", "a.net", "example.net", "x.EXAMPLE.net", "example.com", "w.example.com:80", "org", "b.org", "anet", "casino-win.example.org", "", "poker.de"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/", "/DE/", "/fr/a", "/free-download", "/free/x", "/casino", "/casinos", "\n/en/"]
    urls = [f"{r.choice(['http', 'https', ''])}{r.choice(['://', '://', ':/'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?a=://net/', '#casino', '?xxx'])}" for _ in range(600)] + [None, "", "://", "http://é.net/"]
    df = spark.createDataFrame([(k, u, "t", "h") for k, u in enumerate(urls)] + [(None, "http://a.net/", "", ""), (1, urls[1], "", "")], "page_id long, url string, token string, host string")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(urls) + 2
    for x in got:
        u = (urls[x.page_id] if x.page_id is not None else "http://a.net/") or ""
        m = re.search(r"://([^/?#]*)([^?#]*)", u)
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        best = max(((len(h + p), h + p, v) for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        low = re.sub("[A-Z]", lambda c: c[0].lower(), u)
        verdict = best[2] if best else "block" if any(re.search(p.regex, low) for p in url_filter.PATTERNS) else "allow"
        assert (x.host, x.path, x.rule, x.verdict) == (host, path, best[1] if best else None, verdict), u
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_rules_are_filed_under_the_rarest_token(spark):
    df = spark.createDataFrame([(["example", "net"],)] * 5 + [(["net", "en"],)], "tokens array<string>")
    assert dict((r.name, t) for t, r in url_filter.index(df, url_filter.PLACES))["example.net/en/"] == "en"


def test_archive_round_trip(spark, tmp_path):
    pages = [(3, "http://a/ b\r\nX: y", "one"), (1, None, "one"), (2, "u", None), (5, "u", ""), (9, "u", "é" * 50_000), (4, "u", "one"), (4, "u", "one"), (None, "u", "one"), (8, "", "\r\n\r\nWARC/1.0")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    warc.write_archive(df, str(tmp_path / "a"))
    got = sorted(tuple(x) for x in warc.read_digests(spark, str(tmp_path / "a")).collect())
    want = []
    for p, _, h in pages:
        if p is not None:
            first = min(q for q, _, g in pages if q is not None and (g or "") == (h or ""))
            data = (h or "").encode()
            want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if p == first else "revisit", None if p == first else first))
    assert got == sorted(want, key=lambda x: x[:3])
    records = {x.page_id: x for x in warc.read_records(spark, str(tmp_path / "a")).collect()}
    assert bytes(records[1].record).endswith(b"Content-Length: 3\r\n\r\none\r\n\r\n")
    assert bytes(records[3].record).count(b"\r\n\r\n") == 2 and records[3].url == "http://a/%20b%0D%0AX:%20y"
    assert len({bytes(x.record) for x in records.values()}) == len(records)
    small = str(tmp_path / "b")
    warc.write_archive(df, small, min_bytes=4)
    assert {x.record_type for x in warc.read_digests(spark, small).collect()} == {"response"}
    warc.write_archive(df.limit(0), str(tmp_path / "c"))
    assert warc.read_digests(spark, str(tmp_path / "c")).collect() == []


def test_records_parse_as_warc(spark, tmp_path):
    """The bytes of all records, one after the other, read by the format's own rules."""
    pages = [(k, f"http://h/{k}", t) for k, t in enumerate(["one", "two\r\n\r\n", "one", "", "é\n"])]
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "a"))
    data = b"".join(bytes(x.record) for x in warc.read_records(spark, str(tmp_path / "a")).orderBy("page_id").collect())
    got = []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        first, *fields = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in fields)
        size = int(fields["Content-Length"])
        assert first == "WARC/1.0" and data[size : size + 4] == b"\r\n\r\n"
        got.append((fields["WARC-Type"], fields["WARC-Target-URI"], data[:size].decode(), fields.get("WARC-Refers-To")))
        data = data[size + 4 :]
    assert got == [("response", "http://h/0", "one", None), ("response", "http://h/1", "two\r\n\r\n", None), ("revisit", "http://h/2", "", "<urn:x-page:0>"), ("response", "http://h/3", "", None), ("response", "http://h/4", "é\n", None)]


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("Fly Fishing ",), ("carp",), ("carp",), (None,), ("a.b",)], "words string")
    rules = url_filter.rules_of(table)
    assert [r.name for r in rules] == ["carp", "fly fishing"]
    df = spark.createDataFrame([(1, "http://x.de/fly-fishing"), (2, "http://x.de/flyfishing"), (3, "http://x.de/" + "a" * 100_000 + "/carp")], "page_id long, url string")
    want = {1: "fly fishing", 2: None, 3: "carp"}
    assert {x.page_id: x.pattern for x in url_filter.judge_urls(df, patterns=rules).collect()} == want
    with pytest.raises(ValueError, match="more than 1"):
        url_filter.rules_of(table, 1)


def test_preferences(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    pairs = [(1, t(("user", "q"), ("assistant", "a<|b"), ("user", "é"), ("assistant", "c")), t(("user", "q"), ("assistant", "x"))), (2, t(("user", "q")), t(("user", "q"))), (3, None, t(("assistant", "z"))), (4, t(("user", "q"), ("assistant", "a")), t(("user", "q"), ("assistant", "a"), ("user", "more")))]
    kind = "array<struct<role:string,text:string>>"
    got = {x.conv_id: x for x in chat.format_preferences(spark.createDataFrame(pairs, f"conv_id long, chosen {kind}, rejected {kind}")).collect()}
    assert got[1].prompt == "<|im_start|>user\nq<|im_end|>\n" and got[1].rejected == "<|im_start|>assistant\nx<|im_end|>\n"
    spans = [got[1].chosen[int(s) : int(e)] for s, e in (p.split(":") for p in got[1].chosen_mask.split(","))]
    assert spans == ["a< |b<|im_end|>", "c<|im_end|>"]
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "")
    assert got[3].n_prompt_turns == 0 and got[3].chosen == "" and got[4].rejected_mask == "" and got[4].n_prompt_turns == 2


@pytest.mark.parametrize("module,query", [(chat, "op6_chat_formatting"), (warc, "op8_warc"), (url_filter, "op5_url_filters")])
def test_like_duckdb(spark, tmp_path, module, query):
    con = duckdb.connect()
    con.execute("create table conversations as select * from (values (1, 0, 'user', 'a'), (1, 1, 'assistant', 'b'), (1, 2, 'user', null), (0, 0, 'user', 'a'), (0, 1, 'assistant', 'b'), (0, 0, 'system', 's'), (2, 0, null, 'x'), (2, null, 'assistant', ''), (6, 1, 'assistant', 'd'), (6, 1, 'assistant', 'd'), (8, 1, 'user', 'd'), (null, 1, 'user', 'd')) t(conv_id, turn, role, text)")
    con.execute("create table pages as select * from (values (1, 'http://a.net/casino', 'x'), (2, null, null), (3, 'http://poker.de', 'x'), (4, 'http://b.Example.net/en/?x', 'é')) t(page_id, url, html)")
    for t in ("conversations", "pages"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = getattr(module, query)(spark, str(tmp_path))
    key = lambda x: tuple((v is not None, v) for v in x)
    want = con.execute(module.ORACLE_SQL)
    names = [d[0] for d in want.description]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)
