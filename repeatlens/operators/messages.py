"""Intent of free-text support messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space between a command word and its number, wider
# than the ASCII blanks that \s stands for here.
BLANK = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
NUMBER = r"[0-9]+"


def _has(text: Column, *words: str) -> Column:
    """True when the text holds at least one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(word)) for word in words])


def _command(message: Column, lower: Column, word: str) -> tuple[Column, Column]:
    """Test for "<word> <number>" and the number. The message starts with the
    word; the number belongs to the first such pair anywhere in it."""
    pattern = f"(?i){word}{BLANK}({NUMBER})"
    test = F.startswith(lower, F.lit(f"{word} ")) & message.rlike(pattern)
    return test, F.regexp_extract(message, pattern, 1)


def tag_messages(messages: DataFrame, text: str = "message") -> DataFrame:
    """Messages with their intent and the store number they name, if any.

    Ordered keyword rules; the first that applies decides. All of it is one
    conditional expression per column.
    """
    message = F.col(text)
    lower = F.lower(message)
    has_number = message.rlike(NUMBER)
    number = F.regexp_extract(message, NUMBER, 0)
    no_store = F.lit("")
    beat, beat_store = _command(message, lower, "bir")
    info, info_store = _command(message, lower, "info")
    error, error_store = _command(message, lower, "error")
    last = _has(lower, "last", "latest") & _has(lower, "transaction", "sale", "dispense")
    stock = _has(lower, "stock", "barcode", "ean") & _has(lower, "count", "how many")
    trouble = _has(lower, "error", "issue", "problem") & (_has(lower, "store") | has_number)
    rules = [
        (message.isNull() | (message == ""), "empty", no_store),
        (beat, "heartbeat", beat_store),
        (info, "store_info", info_store),
        (_has(lower, "pharmacy") & has_number, "store_lookup", number),
        (_has(lower, "status") & _has(lower, "pharmac"), "ask_store_status", no_store),
        (
            _has(lower, "patient") & _has(lower, "medication", "history"),
            "ask_patient",
            no_store,
        ),
        (_has(lower, "dispensing", "stats", "statistics"), "today_stats", no_store),
        (
            _has(lower, "recent") & _has(lower, "prescription", "script"),
            "recent_dispenses",
            no_store,
        ),
        (last & ~has_number, "ask_store", no_store),
        (last & _has(lower, "sale"), "last_sale", number),
        (last & _has(lower, "dispense"), "last_dispense", number),
        (last, "no_records", number),
        (stock & ~has_number, "ask_store", no_store),
        (stock, "stock_counts", number),
        (error, "store_errors", error_store),
        (trouble & ~has_number, "ask_store", no_store),
        (trouble, "store_errors", number),
        (_has(lower, "help", "troubleshoot", "issue"), "help", no_store),
    ]
    intent, store = F.lit("unknown"), no_store
    for test, name, named_store in reversed(rules):
        intent = F.when(test, name).otherwise(intent)
        store = F.when(test, named_store).otherwise(store)
    return messages.withColumn("Intent", intent).withColumn(
        "StoreNumber", F.nullif(store, F.lit(""))
    )


def message_intents(messages: DataFrame, text: str = "message") -> DataFrame:
    """Messages per intent, and how many of them name a store."""
    return (
        tag_messages(messages, text)
        .groupBy("Intent")
        .agg(F.count("*").alias("Messages"), F.count("StoreNumber").alias("WithStore"))
    )
