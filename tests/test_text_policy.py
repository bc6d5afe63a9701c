import hashlib

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import identity, links, redaction, text

# Values are put together from parts, so none stands here whole.
A36, A34, A40 = "aB3" * 12, "aB3" * 11 + "x", "0123456789abcdef" * 2 + "01234567"
SECRETS = {
    "Authorization: " + "Bearer " + "abcdef0123456789xyz": "oauth-token",
    "to" + "ken: x9y8z7w6v5u4": "assigned-secret",
    'api' + 'Key = "a1b2c3d4e5f6"': "assigned-secret",
    "AWS_SECRET_KEY=" + "q1w2e3r4t5y6": "assigned-secret",
    "gh" + "p_" + A36: "github-token",
    "npm" + "_" + A36: "npm-token",
    "hf" + "_" + A34: "hf-token",
    "glpat" + "-" + "a1b2c3d4e5f6g7h8i9j0": "gitlab-token",
    "AK" + "IA" + "ABCDEFGH12345678": "aws-key",
    "AI" + "za" + "a1B2c" * 7: "google-key",
    "xox" + "b-123456789012-abcdef": "slack-token",
    "sk_" + "live_" + "a1b2c3d4e5f6g7h8": "stripe-key",
    "ey" + "Jhbgci0iJ9x." + "eyJzdWIiOiIx." + "abcdefghij": "jwt",
    "-----BEGIN RSA " + "PRIVATE KEY-----": "private-key",
    "postgres://user:" + "hunter2pass@db/x": "url-password",
    "blob " + A40: "base64-blob",
}
CLEAN = ["the secret of the token is out", "password: changeme", "token: <your token>", "api_key=your_api_key", "commit " + A40, "image@sha256:" + A40, "-----BEGIN PUBLIC KEY-----", "git@github.com:a/b.git", "gh" + "p_short", "npm" + "_" + A36 + "x", "a_long_identifier_name_made_of_words_only_here", "key-value store", ""]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(t,) for t in [*SECRETS, *CLEAN]]
    return {r.text: r for r in spark.createDataFrame(rows, "text string").select("text", redaction.redacted(F.col("text")).alias("out"), redaction.redacted(redaction.redacted(F.col("text"))).alias("again")).collect()}


@pytest.mark.parametrize("secret", SECRETS)
def test_secrets_are_marked(texts, secret):
    assert f"[REDACTED:{SECRETS[secret]}]" in texts[secret].out


@pytest.mark.parametrize("clean", CLEAN)
def test_clean_texts_stay(texts, clean):
    assert texts[clean].out == clean


def test_redaction_repeats_itself(texts):
    assert all(r.out == r.again for r in texts.values())


def test_confusables_and_nested_values(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "token") + ": x9y8z7w6v5u4"
    d = spark.createDataFrame([(1, wide), (2, "plain"), (3, None)], "id long, text string")
    got = {r.id: r for r in redaction.redact(d).collect()}
    assert got[1].possible_confusable_secret and "REDACTED" in got[1].text and got[1].redactions == 1
    assert (got[2].text, got[2].redactions, got[3].text) == ("plain", 0, None)
    t = "to" + "ken: x9y8z7w6v5u4"
    n = spark.createDataFrame([({"k": [t]}, (t, t))], "m map<string,array<string>>, s struct<a:string,file_path:string>")
    r = redaction.redact_nested(n).first()
    assert "REDACTED" in r.m["k"][0] and "REDACTED" in r.s.a and r.s.file_path == t


def test_hostile_lines_are_quick(spark):
    import time

    d = spark.createDataFrame([("ab-" * 60000,), ("commit " + "x" * 16000 + A40,), ("key" * 50000,)], "text string")
    began = time.time()
    d.select(redaction.redacted(F.col("text"))).collect()
    assert time.time() - began < 20


def one(spark, c, **values):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return d.select(c.alias("out")).first().out


def test_text_shapes(spark):
    t = F.col("t")
    assert one(spark, text.timestamp(t), t=3661.0015) == "01:01:01.002" and one(spark, text.timestamp(t), t=-1.0) == "00:00:00.000"
    assert one(spark, text.fenced(t), t="a\r\n````") == "`````text\na\n````\n`````"
    assert one(spark, text.file_name(t, F.lit("0123456789abcdef")), t="a b/[REDACTED:jwt]?") == "a-b-REDACTED-0123456789ab"
    assert one(spark, text.compared_words(t), t="“Hé”, a_b… C#") == ["hé", "a", "b", "c"]
    assert not one(spark, text.claims_text(t), t="★ +") and one(spark, text.claims_text(t), t="日")
    assert one(spark, text.truth_text(t), t="# note\nkept\n") == "kept" and one(spark, text.truth_text(t), t="x UNVERIFIED") is None
    assert one(spark, text.first_paragraph(t), t="a\r\nb\n\nc") == "a\nb" and one(spark, text.first_paragraph(t), t=" ") is None
    assert one(spark, text.media_seconds(t), t="out_time=01:00:01.5") == 3601.5 and one(spark, text.media_seconds(t), t="frame=1") is None
    p = one(spark, text.download_progress(t), t="[download] 1.5MiB of 3MiB")
    assert (p.percent, p.downloaded_bytes, p.total_bytes, p.indeterminate) == (50.0, 1572864, 3145728, False)


def test_caps_do_not_split(spark):
    t = F.col("t")
    assert one(spark, text.capped(t, 5), t="ab日本") == "ab日"
    assert one(spark, text.capped(t, 4), t="ab日本") == "ab"
    assert one(spark, text.capped(t, 14), t="x [REDACTED:jwt] y") == "x "
    assert one(spark, text.capped(t, 16), t="x [REDACTED:jwt] y") == "x [REDACTED:jwt]"


def test_links(spark):
    lines = "\n".join(["Code: https://github.com/a/b", "Slides at https://x.org/s.", "Paper https://arxiv.org/abs/1. (pdf)", "https://www.linkedin.com/in/a code", "https://youtu.be/x docs", "Sponsored docs https://y.org", "see https://z.org", "again https://github.com/a/b#readme"])
    d = spark.createDataFrame([("s", lines)], "source_id string, text string")
    got = [(r.url, r.label, r.reason) for r in links.extract_links(d, "source_id", "text").orderBy("line_no").collect()]
    assert got == [("https://github.com/a/b", "Code", "code_or_reference_domain"), ("https://x.org/s", "Slides at", "relevant_context"), ("https://arxiv.org/abs/1", "Paper  (pdf)", "code_or_reference_domain")]


def test_video_urls(spark):
    u, v = F.col("u"), "YE7VzlLtp-4"
    for url, found, sure in [(f"https://www.youtube.com/watch?v={v}", v, v), (f"https://youtu.be/{v}?t=3", v, v), (f"https://youtube.com/watch?v={v}&list=", v, None), (f"https://youtube.com/shorts/{v}/x", v, None), (f"https://youtube.com/watch?v={v}x", v + "x", None), (f"https://vimeo.com/{v}", None, None)]:
        assert (one(spark, links.video_id(u), u=url), one(spark, links.certain_video_id(u), u=url)) == (found, sure), url
    assert one(spark, links.plain_video_url(u), u=f"https://youtube.com/watch?v={v}&t=9s&a=#t=4") == f"https://youtube.com/watch?v={v}&a="


def test_fingerprints_and_keys(spark):
    assert one(spark, identity.anchor_offsets(F.col("n")), n=10) == [0]
    assert one(spark, identity.anchor_offsets(F.col("n")), n=65536 * 9) == [65536 * i for i in range(9)]
    assert one(spark, identity.content_fingerprint(F.encode(F.lit("x"), "UTF-8"), F.col("n")), n=6 * 1024**3) is None
    assert one(spark, identity.options_json(F.create_map(F.lit("b"), F.lit("-0.0"), F.lit("a"), F.lit(None).cast("string"))), n=1) == '{"a":null,"b":"0.0"}'


def test_long_values_go_whole(spark):
    a = "aB3" * 10000
    rows = {
        "blob " + a + "== end": "blob [REDACTED:base64-blob] end",
        "ey" + "J" + a + "." + a + "." + a: "[REDACTED:jwt]",
        "glpat" + "-" + a: "[REDACTED:gitlab-token]",
        "xox" + "b-" + a: "[REDACTED:slack-token]",
        "sk_" + "live_" + a: "[REDACTED:stripe-key]",
        "sk" + "-" + a: "[REDACTED:api-key]",
        "Bearer" + " " + a + " x": "Bearer [REDACTED:oauth-token] x",
        "to" + "ken: " + a: "token: [REDACTED:assigned-secret]",
        "postgres://" + "u" * 300 + ":" + a + "@db": "postgres://" + "u" * 300 + ":[REDACTED:url-password]@db",
        "https://" + a + "@db": "https://[REDACTED:url-user]@db",
        "-----BEGIN RSA " + "PRIVATE KEY-----" + a + "-----END RSA " + "PRIVATE KEY-----": "[REDACTED:private-key]",
    }
    d = spark.createDataFrame([(k,) for k in rows], "text string")
    for r in d.select("text", redaction.redacted(F.col("text")).alias("out"), redaction.redacted(redaction.redacted(F.col("text"))).alias("again")).collect():
        assert (r.out, r.again) == (rows[r.text], rows[r.text])


def test_corpus_digest_is_folded_in_order_without_one_list(spark):
    rows = [(i * 7919 % 5003, f"i{i}", None if i % 5 == 0 else f"t{i}") for i in range(3000)] + [(None, "n", "n"), (9, "twice", "a"), (9, "twice", "b")]
    each = sorted(((k is not None, k or 0), hashlib.sha256(f"{i}\x00{t or ''}".encode()).hexdigest()) for k, i, t in rows)
    d = spark.createDataFrame(rows, "at long, image string, truth string").repartition(5)
    digest = lambda x: hashlib.sha256(("labels:" + ":".join(x)).encode()).hexdigest()
    made = identity.corpus_digest(d, "labels", "at", "image", "truth")
    assert [r.digest for r in made.collect()] == [digest([x for _, x in each])]
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [r.digest for r in identity.corpus_digest(d.limit(0), "labels", "at", "image", "truth").collect()] == [digest([])]


def test_json_of_any_shape_is_redacted_like_a_walk(spark):
    import json
    import random

    rnd = random.Random(3)
    secret, mark = "Bearer " + "abcdef0123456789xyz", "Bearer [REDACTED:oauth-token]"

    def made(depth):
        kind = rnd.randrange(7 if depth < 5 else 4)
        if kind < 4:
            return rnd.choice([secret, "plain \"é\" \\ \n{[:,", 1.50, 10**30, None, True, f"say {secret} !", ""])
        if kind < 6:
            return {rnd.choice(["a", "path", "file_path", secret, "x:y", ""]) + rnd.choice(["", "1"]): made(depth + 1) for _ in range(rnd.randrange(4))}
        return [made(depth + 1) for _ in range(rnd.randrange(4))]

    def walk(v, name=""):
        if isinstance(v, str):
            return v if name == "path" or name.endswith("_path") else v.replace(secret, mark)
        if isinstance(v, dict):
            return {k: walk(x, k) for k, x in v.items()}
        return [walk(x, name) for x in v] if isinstance(v, list) else v

    values = [made(0) for _ in range(150)]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, v in enumerate(values)]
    odd = [None, "", "{", f"no json {secret}", f'{{"a": "{secret}"', "[" * 5000 + f'"{secret}"' + "]" * 5000, '{"n":  1.50e+00 , "s":"\\u0041" }']
    d = spark.createDataFrame(list(enumerate(texts + odd)), "i int, t string")
    got = [r.s for r in d.select("i", redaction.redacted_json(F.col("t")).alias("s")).orderBy("i").collect()]
    for text_, value, safe in zip(texts, values, got, strict=False):
        assert json.loads(safe) == walk(value)
        if walk(value) == value:
            assert safe == text_
    assert got[150:] == [None, "", "{", f"no json {mark}", f'{{"a": "{mark}"', "[" * 5000 + f'"{mark}"' + "]" * 5000, odd[-1]]
    v = d.where("i < 100").select("i", F.parse_json("t").alias("v"), F.struct(F.parse_json("t").alias("w")).alias("s"))
    safe = redaction.redact_nested(v)
    rows = safe.select("i", F.to_json("v").alias("v"), F.to_json("s.w").alias("w")).collect()
    assert all(json.loads(r.v) == json.loads(r.w) == walk(values[r.i]) for r in rows)
    with pytest.raises(ValueError):
        redaction.redact_nested(d.select(F.array(F.parse_json(F.lit("1"))).alias("a")))
