"""Reading, parsing and normalising log lines."""

import html
from urllib.parse import unquote, unquote_plus

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from logwarden.functions.decode import clean_unicode, decode_rounds, drop_controls
from logwarden.functions.text import endpoint_group, split_uri, valid_ip
from logwarden.operators.normalize import normalize
from logwarden.operators.parse import parse_access_log, parse_iis_log
from logwarden.operators.preprocess import preprocess
from logwarden.schema import COMMON_FIELDS, PREPROCESS_FIELDS
from logwarden.sources import lines as S, structured as C

COMBINED = '192.168.1.10 - - [31/May/2026:12:00:00 +0700] "{}" 200 532 "-" "Mozilla/5.0"'


def parse(spark, lines, server="apache"):
    df = spark.createDataFrame([(i + 1, line) for i, line in enumerate(lines)], "line_number bigint, line string")
    return [r.asDict() for r in parse_access_log(df, server).orderBy("line_number").collect()]


def test_combined_and_common_profiles(spark):
    full = COMBINED.format("get /a?b=1 HTTP/1.1")
    rows = parse(spark, [full, '1.2.3.4 - - [x] "GET / HTTP/1.0" 404 -', full + " rt=0.2", '1.2.3.4 - - [x] "GET / HTTP/1.0" 404 - tail'])
    assert [r["format_profile"] for r in rows] == ["combined", "common", "combined_with_tail", "common_with_tail"]
    assert rows[0]["http_method"] == "GET" and rows[0]["raw_uri"] == "/a?b=1"
    assert rows[1]["response_size"] == 0 and rows[1]["referrer"] == "-"
    assert rows[2]["extra_tail"] == "rt=0.2" and rows[3]["extra_tail"] == "tail"
    assert rows[0]["event_id"].startswith("apache:1:") and len(rows[0]["event_id"].split(":")[2]) == 12


def test_request_forms(spark):
    rows = parse(spark, [COMBINED.format(q) for q in (
        'GET /x?q="a" HTTP/1.1', "GET /a b c HTTP/1.1", "GET /noversion", "GET /x HTTP/1.1 extra", r"GET /a\nb HTTP/1.1", "BREW /x HTTP/1.1")])
    assert rows[0]["raw_uri"] == '/x?q="a"' and rows[1]["raw_uri"] == "/a b c"
    assert rows[2]["raw_uri"] == "/noversion" and rows[2]["http_version"] is None
    assert [r["error_message"] for r in rows[3:]] == [
        "Request field does not match expected format", "Request field contains forbidden control marker",
        "Invalid http_method in request field"]
    assert all(r["source_ip"] is None and r["raw_log"] for r in rows[3:])


def test_field_errors_and_mark_character(spark):
    line = COMBINED.format("GET / HTTP/1.1")
    rows = parse(spark, [line.replace("192.168.1.10", "300.1.1.1"), line.replace(" 200 ", " 700 "), line.replace(" 532 ", " -5 "),
                         line.replace("Mozilla", "Moz\x01illa"), "nonsense"], "nginx")
    assert [r["error_message"] for r in rows[:4]] == ["Invalid source_ip", "Invalid status_code", "Invalid response_size", None]
    assert rows[3]["user_agent"] == "Moz\x01illa/5.0"
    assert rows[4]["error_message"].startswith("No Nginx log pattern matched")


def test_iis_header_state_and_quotes(spark):
    lines = ["2024-01-01 00:00:00 1.1.1.1 GET /a - 200", "#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query sc-status cs(User-Agent)",
             '2024-01-01 00:00:01 1.1.1.1 get /a x=1 200 "My Agent"', "2024-01-01 00:00:01 1.1.1.1 GET /a x=1 200", '2024 "open', "#Fields: c-ip cs-method sc-status",
             "::1 POST 500", "nope POST 500"]
    df = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(lines)], "file string, line_number bigint, line string")
    rows = parse_iis_log(df).orderBy("line_number").collect()
    assert [r.line_number for r in rows] == [1, 3, 4, 5, 7, 8]
    assert rows[0].error_message == "Missing #Fields header before IIS data line"
    assert (rows[1].raw_uri, rows[1].user_agent, rows[1].timestamp, rows[1].data_line_number) == ("/a?x=1", "My Agent", "2024-01-01 00:00:01", 1)
    assert rows[2].error_message == "IIS field count mismatch: expected 8, got 7"
    assert rows[3].error_message == "Malformed quoted IIS fields: No closing quotation"
    assert (rows[4].source_ip, rows[4].referrer, rows[4].data_line_number) == ("::1", "-", 2)
    assert rows[5].error_message == "Invalid source_ip"


@pytest.mark.parametrize("text,ok", [("1.2.3.4", True), ("01.2.3.4", False), ("::", True), ("::ffff:1.2.3.4", True), ("2001:DB8::1", True),
                                     ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7:8:9", False), ("1::2::3", False), ("12345::", False), ("abc", False), ("fe80::1%eth0", True)])
def test_ip(spark, text, ok):
    got = spark.createDataFrame([(text,)], "x string").select(valid_ip(F.col("x"))).first()[0]
    assert got == (text.lower() if ok else None)


def test_normalize_defaults_and_errors(spark):
    schema = "event_id string, timestamp string, source_ip string, http_method string, raw_uri string, original_url string, status_code string, response_size string, user_agent string, referrer string, server_type string, raw_log string, line_number int, parse_error boolean, parse_status string, error_message string"
    rows = [("a", "31/May/2026:12:00:00 +0700", "1.2.3.4", "get", "/p?a=1#f?x", None, "200", "-", " - ", "", "Apache", "r", 1, False, "success", None),
            ("b", "bad", "x", "NOPE", None, None, "42", "-3", None, None, "weird", "r", 2, False, "success", None),
            ("c", None, None, None, None, None, None, None, None, None, "nginx", "r", 3, True, "error", "boom"),
            ("d", "2024-01-01 10:00:00.5", "::1", "POST", "/", "/o", "500", "7", "ua", "r", "iis", "r", 4, False, "", None)]
    a, b, c, d = normalize(spark.createDataFrame(rows, schema)).orderBy("line_number").collect()
    assert a.__fields__ == COMMON_FIELDS
    assert str(a.timestamp) == "2026-05-31 05:00:00" and (a.uri, a.query_string, a.fragment) == ("/p", "a=1", "f?x")
    assert a.original_url == "/p?a=1#f?x" and a.user_agent is None and a.response_size_missing and a.normalize_status == "success"
    assert b.normalize_errors == ["server_type_invalid", "source_ip_invalid", "http_method_invalid", "status_code_invalid", "response_size_invalid"] or b.normalize_errors == [
        "server_type_invalid", "timestamp_invalid", "source_ip_invalid", "http_method_invalid", "status_code_invalid", "response_size_invalid"]
    assert c.error_message == "boom" and c.normalize_errors == ["parse_error"] and not c.status_code_invalid
    assert d.parse_error and d.normalize_errors[0] == "parse_status_missing" and str(d.timestamp) == "2024-01-01 10:00:00.500000"


def test_split_uri(spark):
    got = [tuple(r) for r in spark.createDataFrame([("/a?b?c#d",), ("http://h/x#?y",), ("#f",), ("",), ("/p?",)], "u string").select(
        *[c for c in split_uri(F.col("u")).values()]).collect()]
    assert got == [("/a", "b?c", "d"), ("/x", "", "?y"), (None, "", "f"), (None, None, None), ("/p", "", None)]


@pytest.mark.parametrize("uri,group", [("/api/v1/auth/login", "api_v1"), ("/api/db-backup", "sensitive"), ("/admin/settings", "sensitive"),
                                       ("/index.html", "index.html"), ("", "root"), (None, "root"), ("/", "root"), ("/API?x=admin", "api")])
def test_endpoint_group(spark, uri, group):
    assert spark.createDataFrame([(uri,)], "u string").select(endpoint_group(F.col("u"))).first()[0] == group


def by_hand(text, plus):
    depth = 0
    for i in range(5):
        new = (unquote_plus if plus and i == 0 else unquote)(html.unescape(text))
        if new == text:
            break
        text, depth = new, depth + 1
    return text, depth


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab%2537eE&#x;<>l tgamp+'\"é/.=")), max_size=24), min_size=20, max_size=40))
def test_decode_matches_plain_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for plus in (False, True):
        got = [(r.d["text"], r.d["depth"]) for r in df.select(decode_rounds(F.col("x"), 5, plus).alias("d")).collect()]
        assert got == [by_hand(t, plus) for t in texts]


def test_preprocess(spark):
    rows = [("/a%252e%252e/+x", "q=a+b&lt;", "ＡＬＥＲＴ​", "GET"), ("/x" * 20, None, "a\x00b\tc  d", None), ("%25" * 3 + "252525252541", "", "", "")]
    df = spark.createDataFrame(rows, "uri string, query_string string, user_agent string, http_method string")
    p = preprocess(df, max_length=30)
    a, b, c = p.collect()
    assert set(PREPROCESS_FIELDS) <= set(p.columns)
    assert (a.decoded_uri, a.decode_depth_uri, a.decoded_query_string) == ("/a../+x", 2, "q=a b<")
    assert a.normalized_user_agent == "alert" and a.removed_control_chars and a.normalized_request == "method=get | url=/a../+x?q=a b< | user_agent=alert"
    assert b.preprocess_errors == ["uri_truncated", "control_chars_removed_user_agent"] and b.normalized_user_agent == "abc d"
    assert c.decode_limit_reached_uri and "decode_limit_reached_uri" in c.preprocess_errors
    with pytest.raises(ValueError):
        preprocess(p, overwrite=False)
    assert "preprocess_fields_overwritten" in preprocess(p).first().preprocess_errors


def test_full_nfkc_option(spark):
    df = spark.createDataFrame([("ﬁle Ａ",)], "t string")
    assert df.select(drop_controls(clean_unicode(F.col("t"), True))).first()[0] == "file a"


def test_read_records(spark, tmp_path):
    folder = tmp_path / "nginx"
    folder.mkdir()
    content = b"\xef\xbb\xbffirst\r\nsecond caf\xe9\r\n\r\n  more\n\tmore2\rthird caf\xc3\xa9\n   \nlast"
    (folder / "access.log").write_bytes(content)
    want = [("first", ["had_utf8_bom"], [1, 1]), ("second café\\n  more\\n\tmore2", ["decode_fallback_latin1", "continuation_merged"], [2, 5]),
            ("third café", [], [6, 6]), ("last", [], [8, 8])]
    rows = S.read_log_records(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(r.line, r.flags, r.physical_line_range) for r in rows] == want
    assert [r.line_number for r in rows] == [1, 2, 3, 4] and rows[0].server_type == "nginx"
    binary = S.merge_continuations(S.lines_from_binary(spark.read.format("binaryFile").load(str(folder)).select(F.col("path").alias("file"), "content")))
    assert [(r.line, r.flags, r.physical_line_range) for r in binary.orderBy("line_number").collect()] == want


def test_large_file_in_splits_keeps_order(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = S.read_physical_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 1
        bad = lines.where(F.col("line") != F.concat(F.lit("line "), (F.col("physical_line") - 1).cast("string"))).count()
        assert bad == 0 and lines.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_render_and_parse_round_trip(spark):
    df = spark.createDataFrame([("2024-05-01T10:00:00+02:00", "GET", '/a?x="1"', "1.2.3.4", "UA"), ("2024-05-01 10:00:00", "post", "/", None, None)],
                               "timestamp string, method string, url string, ip string, ua string")
    lines = [r.line for r in C.structured_to_lines(df).collect()]
    assert lines[0] == '1.2.3.4 - - [01/May/2024:10:00:00 +0200] "GET /a?x=\\"1\\" HTTP/1.1" 200 0 "-" "UA"'
    assert lines[1] == '0.0.0.0 - - [01/May/2024:10:00:00 +0000] "POST / HTTP/1.1" 200 0 "-" "-"'
    assert parse(spark, lines)[0]["raw_uri"] == '/a?x=\\"1\\"'
