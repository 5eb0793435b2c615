"""The batch protocol: seven fields parted by tabs in, a status and hex out; one bad line is one error reply.

Fields: lang, input_case, post, limit, pre, punct, hex of the UTF-8 text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaspark.api import Normalizer
from verbaspark.runtime import ship


def request(text: Column, lang: Column) -> Column:
    """A request line with the usual options."""
    return F.concat_ws("\t", lang, F.lit("cased"), F.lit("1"), F.lit("729"), F.lit("0"), F.lit("1"), F.lower(F.hex(F.encode(text, "UTF-8"))))


def reply_one(line: str) -> str:
    try:
        fields = line.split("\t")
        if len(fields) != 7:
            raise ValueError("seven fields parted by tabs are expected")
        lang, case, post, limit, pre, punct, body = fields
        normalizer = Normalizer(lang, case, post == "1", int(limit))
        said = normalizer.normalize(bytes.fromhex(body).decode("utf-8"), pre == "1", punct == "1")
        return f"OK\t{said.encode('utf-8').hex()}"
    except UnicodeError as e:
        return f"ERR\tUnicodeError\t{str(e).encode().hex()}"
    except ValueError as e:
        return f"ERR\tValueError\t{str(e).encode().hex()}"


def replies(df: DataFrame, column: str = "line", out: str = "reply") -> DataFrame:
    """``df`` with a reply to each request line; null stays null. Works on a stream as on a table."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def answer(lines: pd.Series) -> pd.Series:
        return lines.map(reply_one, na_action="ignore")

    return df.withColumn(out, answer(column))
