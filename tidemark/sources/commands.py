"""Operation logs from captured commands, and the replies that front ends give.

A command is a line of words or a JSON object. Both become rows (queue, op, value, deadline_kind,
deadline_arg_ms, id, id_any, count, timeout_ms, error); error is null for a valid one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import duration_ms, rfc3339_ms, signed, unsigned

# Each command's name and the numbers of words that may follow it.
ARGUMENTS = {
    "ENQUEUE": (2, 4),
    "DEQUEUE": (1, 3, 5),
    "REQUEUE": (2, 4),
    "RELEASE": (2,),
    "INFO": (0, 1),
    "PEEK": (1,),
    "PING": (0, 1),
    "DELETE": (1,),
    "COMPACT": (1,),
}
# The status of each failure over HTTP, gRPC and the Redis protocol.
REPLIES = {
    "OK": (200, "OK", "+OK"),
    "NoSuchQueue": (404, "NOT_FOUND", "-ERR no such queue"),
    "NoItemReady": (204, "UNAVAILABLE", "*-1"),
    "ItemNotDequeued": (409, "FAILED_PRECONDITION", "-ERR item not dequeued"),
    "Internal": (500, "INTERNAL", "-ERR internal error"),
    "Canceled": (503, "ABORTED", "-ERR canceled"),
}


def parse_commands(lines: DataFrame, text: str = "command") -> DataFrame:
    """The operations of lines of words separated by spaces; other columns stay."""
    return parse_words(lines.withColumn("__words", F.split(F.trim(F.col(text)), " +")), "__words")


def parse_words(rows: DataFrame, words: str) -> DataFrame:
    """The operations of arrays of words, which may hold any characters; other columns stay."""
    out = rows.withColumnRenamed(words, "__w").withColumn("__n", F.size("__w") - 1).withColumn("op", F.upper(F.get("__w", F.lit(0))))

    def word(i: int) -> Column:
        return F.get("__w", F.lit(i))

    def option(first: int, *names: str) -> Column:
        """The word after the last of the keywords, which stand at `first` and every second place on."""
        found = F.lit(None).cast("string")
        for i in (first, first + 2):
            found = F.when(F.upper(word(i)).isin(*names) & (F.col("__n") > i), word(i + 1)).otherwise(found)
        return found

    op, n = F.col("op"), F.col("__n")
    arity = F.lit(False)
    for name, counts in ARGUMENTS.items():
        arity = arity | ((op == name) & n.isin(*counts))
    timed = op.isin("ENQUEUE", "REQUEUE")
    keyword = F.when(timed & (n == 4), F.upper(word(3)))
    argument = F.when(timed & (n == 4), signed(word(4)))
    counted = op == "DEQUEUE"
    count_word, timeout_word = (F.when(counted, option(2, k)) for k in ("COUNT", "TIMEOUT"))
    by_id = op.isin("REQUEUE", "RELEASE")
    any_ = by_id & (F.upper(word(2)) == "ANY")
    odd_option = counted & (((n >= 3) & ~F.upper(word(2)).isin("COUNT", "TIMEOUT")) | ((n >= 5) & ~F.upper(word(4)).isin("COUNT", "TIMEOUT")))
    error = (
        F.when(~op.isin(*ARGUMENTS), "command not supported")
        .when(~arity, F.concat(F.lit("invalid number of arguments, "), n))
        .when(timed & (n == 4) & argument.isNull(), "invalid deadline value")
        .when((keyword == "DELAY") & (argument < 0), "delay must be non-negative")
        .when(keyword.isNotNull() & ~keyword.isin("DELAY", "DEADLINE"), "unexpected keyword")
        .when(by_id & ~any_ & unsigned(word(2)).isNull(), 'expected ID or "ANY"')
        .when(odd_option, "invalid argument")
        .when(count_word.isNotNull() & (F.coalesce(unsigned(count_word), F.lit(0)) < 1), "invalid count")
        .when(timeout_word.isNotNull() & unsigned(timeout_word).isNull(), "invalid timeout")
    )
    out = out.withColumns(
        {
            "queue": word(1),
            "value": F.when(op == "ENQUEUE", word(2)),
            "deadline_kind": F.when(timed, F.when(keyword == "DELAY", "relative").when(keyword == "DEADLINE", "absolute").otherwise("now")),
            "deadline_arg_ms": argument,
            "id": F.when(by_id, unsigned(word(2))),
            "id_any": any_,
            "count": F.when(counted, F.coalesce(unsigned(count_word), F.lit(1).cast("long"))),
            "timeout_ms": F.when(counted, F.coalesce(unsigned(timeout_word), F.lit(0).cast("long"))),
            "error": error,
        }
    )
    return out.drop("__w", "__n")


#: The fields that bodies and query strings may have, as texts.
_FIELDS = ("value", "string", "deadline", "timeout", "count", "id", "any")
# What each method and last part of a path asks for; a path without one has the queue's name last.
ROUTES = {
    ("POST", "enqueue"): "ENQUEUE",
    ("POST", "dequeue"): "DEQUEUE",
    ("POST", "requeue"): "REQUEUE",
    ("POST", "release"): "RELEASE",
    ("POST", "compact"): "COMPACT",
    ("GET", "peek"): "PEEK",
    ("GET", "poke"): "POKE",
    ("GET", ""): "INFO",
    ("DELETE", ""): "DELETE",
}


def _deadline(text: Column) -> tuple[Column, Column]:
    """The kind and the argument of a deadline: none, "+" and a duration, milliseconds or a date."""
    kind = F.when(text.isNull(), "now").when(text.startswith("+"), "relative").otherwise("absolute")
    return kind, F.when(kind == "relative", duration_ms(F.substr(text, F.lit(2)))).when(kind == "absolute", F.coalesce(signed(text), rfc3339_ms(text)))


def _value(fields: Column) -> Column:
    """The payload: base64 in the field value, or plain in the field string."""
    return F.coalesce(fields["string"], F.try_to_binary(fields["value"], F.lit("base64")).cast("string"))


def parse_json_enqueue(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The value and deadline of JSON enqueue bodies; the value is base64 unless it is given in the field string."""
    fields = F.from_json(F.col(body), ", ".join(f"{f} string" for f in _FIELDS))
    kind, argument = _deadline(fields["deadline"])
    kept = [c for c in bodies.columns if c != body]
    return bodies.select(*kept, _value(fields).alias("value"), kind.alias("deadline_kind"), argument.alias("deadline_arg_ms"))


def parse_http(requests: DataFrame) -> DataFrame:
    """The operations of HTTP requests (method, path, body); other columns stay.

    Fields come from a JSON body or, where there is none, from the path's query string. An unknown route, a body that is
    no JSON object and a field of a wrong form have an error; so has a value, id or deadline that is missing where
    the operation needs it.
    """
    kinds = ", ".join(f"{f} string" for f in _FIELDS)
    path = F.regexp_extract("path", r"^([^?]*)", 1)
    asked = F.regexp_extract("path", r"^[^?]*\?(.*)$", 1)
    last = F.regexp_extract(path, r"^/queues/[^/]+/([a-z]+)$", 1)
    known = path.rlike(r"^/queues/[^/]+(/[a-z]+)?$")
    found = F.lit(None).cast("string")
    for (method, part), name in ROUTES.items():
        found = F.when(known & (F.col("method") == method) & (last == part), name).otherwise(found)
    pairs = F.expr("transform_values(str_to_map(__q, '&', '='), (k, v) -> if(v IS NULL, '', try_url_decode(v)))")
    out = requests.withColumns({"op": found, "queue": F.try_url_decode(F.regexp_extract(path, r"^/queues/([^/]+)", 1)), "__q": asked})
    out = out.withColumn("__p", F.when(F.col("__q") != "", pairs)).withColumn("__j", F.from_json("body", kinds))
    out = out.withColumn("__f", F.when(F.col("body").isNotNull(), F.col("__j")).otherwise(F.struct(*[F.col("__p")[f].alias(f) for f in _FIELDS])))
    f, op = F.col("__f"), F.col("op")
    inner = F.from_json(f["id"], "id string, any string")
    nested = (op == "REQUEUE") & F.col("body").isNotNull()
    id_, any_ = F.when(nested, inner["id"]).otherwise(f["id"]), F.when(nested, inner["any"]).otherwise(f["any"])
    by_id, timed, counted = op.isin("REQUEUE", "RELEASE"), op.isin("ENQUEUE", "REQUEUE"), op == "DEQUEUE"
    is_any = by_id & F.coalesce(any_.isin("true", ""), F.lit(False))
    kind, argument = _deadline(f["deadline"])
    timeout = F.coalesce(unsigned(f["timeout"]), duration_ms(f["timeout"]))
    wrong = F.col("body").isNotNull() & ~F.coalesce(F.trim("body").startswith("{") & F.expr("try_parse_json(body) IS NOT NULL"), F.lit(False))
    error = (
        F.when(op.isNull(), "not found")
        .when(wrong, "invalid body")
        .when((op == "ENQUEUE") & _value(f).isNull(), "missing value")
        .when(timed & (kind != "now") & argument.isNull(), "invalid deadline")
        .when((op == "REQUEUE") & (kind == "now"), "missing deadline")
        .when(by_id & ~is_any & unsigned(id_).isNull(), "invalid id")
        .when(counted & f["count"].isNotNull() & (F.coalesce(unsigned(f["count"]), F.lit(0)) < 1), "invalid count")
        .when(counted & f["timeout"].isNotNull() & timeout.isNull(), "invalid timeout")
    )
    out = out.withColumns(
        {
            "value": F.when(op == "ENQUEUE", _value(f)),
            "deadline_kind": F.when(timed, kind),
            "deadline_arg_ms": F.when(timed, argument),
            "id": F.when(by_id & ~is_any, unsigned(id_)),
            "id_any": F.coalesce(is_any, F.lit(False)),
            "count": F.when(counted, F.coalesce(unsigned(f["count"]), F.lit(1).cast("long"))),
            "timeout_ms": F.when(counted, F.coalesce(timeout, F.lit(0).cast("long"))),
            "error": error,
        }
    )
    return out.drop("__q", "__p", "__j", "__f")


def replies(responses: DataFrame) -> DataFrame:
    """responses with the code that each front end gives their status."""
    status = F.col("status")

    def coded(i: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for name, codes in REPLIES.items():
            out = F.when(status == name, F.lit(codes[i]).cast(kind)).otherwise(out)
        return out

    return responses.withColumns({"http": coded(0, "int"), "grpc": coded(1, "string"), "resp": coded(2, "string")})
