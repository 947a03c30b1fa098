"""Stored conditions against pandas, and texts that are refused."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.conditions import LONGEST, Refused, compile_condition
from marketloom.operators import portfolio

COLUMNS = portfolio.RULE_COLUMNS
ROWS = [("A", 10.0, 5.0, 0.1), ("B", 3.0, None, -0.2), ("C", None, 7.0, None), ("D", 100.0, 1.0, 0.0)]
TEXTS = ["price > 5", "price > 5 and rate > 0", "price < 5 or quantity == 7", "not price > 5", "price != 10", "1 < price < 50", "symbol in ['A', 'C']", "symbol not in ('A', 'C')", "(price > 5) & ~(quantity < 3)",
         "price * 2 + 1 > quantity - -4", "symbol == 'B' or price / 4 >= 25", "rate <= 0 | price == 10"]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(ROWS, "symbol string, price double, quantity double, rate double")


@pytest.mark.parametrize("text", TEXTS)
def test_conditions_say_what_pandas_says(rules, text):
    want = pd.DataFrame(ROWS, columns=list(COLUMNS)).query(text).symbol.tolist()
    got = [r.symbol for r in rules.filter(compile_condition(text, COLUMNS)).orderBy("symbol").collect()]
    assert got == want


@pytest.mark.parametrize("text", ["", "price", "1", "price.apply(exit)", "__import__('os').system('ls')", "secret > 1", "price > 'a'", "symbol > 1 and", "price[0] > 1", "lambda: 1", "price ** 9 > 1", "(price := 3) > 1", "price > 5; rate > 1",
                                  "f'{price}' == 'a'", "symbol in 'abc'", "price in [1, 'a']", "not 5", "(" * 300 + "price" + ")" * 300, "~" * 200 + "(price > 1)", "price > 1 or " * 400 + "price > 2", "@x > 1", "price > 1 -- x", "rate <= 0 ^ price == 10"])
def test_other_texts_are_refused(text):
    with pytest.raises(Refused):
        compile_condition(text, COLUMNS)
    assert LONGEST < 13 * 400


def test_each_row_by_its_own_text(spark):
    rows = [("A", 10.0, 1.0, 0.0, "price > 5"), ("B", 4.0, 1.0, 0.0, "price > 5"), ("C", 4.0, 1.0, 0.0, "price < 5"), ("D", 4.0, 1.0, 0.0, None), ("E", 4.0, 1.0, 0.0, "exit()"), ("F", None, 1.0, 0.0, "price < 5")]
    rules = spark.createDataFrame(rows, "symbol string, price double, quantity double, rate double, condition string")
    assert sorted(r.symbol for r in portfolio.condition_orders(rules).collect()) == ["A", "C"]
    assert [r.condition for r in portfolio.refused_conditions(rules).collect()] == ["exit()"]
    assert portfolio.condition_orders(rules.filter(F.lit(False))).count() == 0
