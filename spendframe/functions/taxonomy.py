"""Spending categories from whole-word keywords in a description."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendframe.functions.case import case

OTHER = "Other / Misc"

# Categories in order of priority, each with its keywords.
TAXONOMY: dict[str, list[str]] = {
    "Food & Dining": [
        "restaurant", "cafe", "mcdonalds", "starbucks", "zomato", "swiggy", "uber eats",
        "food", "pizza", "burger", "dining", "doordash", "grubhub", "deli", "bakery",
        "groceries", "supermarket", "mart", "dmart", "walmart", "kfc", "subway",
    ],
    "Transport & Auto": [
        "uber", "lyft", "train", "gas", "shell", "transit", "metro", "fuel", "flight",
        "petrol", "diesel", "taxi", "cab", "toll", "parking", "auto", "airline", "ola",
        "irctc",
    ],
    "Utilities & Bills": [
        "electric", "water", "internet", "wifi", "telecom", "mobile", "bill", "recharge",
        "broadband", "utility", "trash", "power", "phone", "at&t", "verizon", "jio",
        "airtel",
    ],
    "Entertainment & Leisure": [
        "netflix", "spotify", "steam", "cinema", "movie", "prime", "hulu", "gym", "fun",
        "hobbies", "hobby", "game", "gaming", "concert", "event", "club", "bar", "pub",
        "ticket",
    ],
    "Shopping & Retail": [
        "amazon", "target", "flipkart", "store", "mall", "clothes", "apparel",
        "electronics", "shoe", "gift", "gifts", "retail", "shop", "myntra", "nykaa",
    ],
    "Health & Wellness": [
        "pharmacy", "doctor", "clinic", "hospital", "cvs", "walgreens", "health",
        "fitness", "yoga", "dental", "medical", "medicine", "apollo",
    ],
    "Transfers & Income": [
        "pocket money", "salary", "deposit", "refund", "transfer", "cashback",
        "venmo", "paypal", "zelle", "upi", "paytm",
    ],
}


def keyword_pattern(keywords: list[str]) -> str:
    """Java pattern that finds any keyword as whole words, in any script.

    The look-ahead on first letters spares the alternation at most positions.
    """
    starts = "".join(sorted({re.escape(word[0]) for word in keywords}))
    words = "|".join(re.escape(word) for word in keywords)
    return rf"(?U)\b(?=[{starts}])(?:{words})\b"


def category(text: Column, taxonomy: dict[str, list[str]] | None = None,
             other: str = OTHER) -> Column:
    """First category of the taxonomy with a keyword in the text, else ``other``.

    One search over all keywords comes first, so a text without any keyword costs
    one pass and not one per category.
    """
    taxonomy = TAXONOMY if taxonomy is None else taxonomy
    groups = {name: words for name, words in taxonomy.items() if words}
    if not groups:
        return F.lit(other)
    lowered = F.lower(text)
    by_priority = case(
        [(lowered.rlike(keyword_pattern(words)), F.lit(name)) for name, words in groups.items()],
        F.lit(other),
    )
    every_word = [word for words in groups.values() for word in words]
    return F.when(lowered.rlike(keyword_pattern(every_word)), by_priority).otherwise(F.lit(other))
