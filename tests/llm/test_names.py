"""op9: names of more than two words, with initials and particles."""

import re

from haulspark.llm import pii

TEXTS = [
    "Mr. Juan Carlos Garcia met Mr. Garcia today.",
    "Dr. J. Smith and Dr. Smith agree.",
    "Dr. J.R. Smith, Prof John F. Kennedy, Mr. A.Lopez.",
    "Herr Ludwig van Beethoven, Frau von Bismarck, Sr. de la Cruz.",
    "Ask Mr. Brown I think, or Mr. John Miller Jr, Mrs. Ann Taylor Dr. Wilson.",
    "Господин Иван Петрович Сидоров и господин Сидоров.",
]
NAMES = {"Juan", "Carlos", "Garcia", "Smith", "John", "Kennedy", "Lopez", "Ludwig", "Beethoven", "Bismarck", "Cruz", "Brown",
         "Miller", "Ann", "Taylor", "Wilson", "Иван", "Петрович", "Сидоров"}


def test_whole_names_are_replaced(spark):
    texts = [t.replace("Господин", "господин") for t in TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in sorted(pii.replace(df, "k1").collect())]
    for text in out:
        assert not NAMES & set(re.findall(r"\w+", text)), text
    one, two, surname, again = re.match(r"Mr\. (\w+) (\w+) (\w+) met Mr\. (\w+) today\.$", out[0]).groups()
    assert surname == again and one != two
    initial, smith, other = re.match(r"Dr\. (\w)\. (\w+) and Dr\. (\w+) agree\.$", out[1]).groups()
    assert smith == other and initial != "J"
    third = re.match(r"Dr\. (\w)\.(\w)\. (\w+), Prof \w+ (\w)\. \w+, Mr\. (\w)\.\w+\.$", out[2]).groups()
    assert third[2] == smith and third[0] == initial and third[1] != "R" and third[3] != "F" and third[4] != "A"
    assert re.match(r"Herr \w+ van \w+, Frau von \w+, Sr\. de la \w+\.$", out[3])
    assert re.match(r"Ask Mr\. \w+ I think, or Mr\. \w+ \w+ Jr, Mrs\. \w+ \w+ Dr\. \w+\.$", out[4])
    a, b = re.match(r"господин \w+ \w+ (\w+) и господин (\w+)\.$", out[5]).groups()
    assert a == b
