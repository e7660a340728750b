"""The fixed table of honours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (role, first team, names).
HONOURS = (
    ("Blocker", True, ("Trent Williams", "Tristan Wirfs", "Joel Bitonio", "Zack Martin", "Jason Kelce")),
    ("Rusher", True, ("T.J. Watt", "Myles Garrett", "Aaron Donald", "Cameron Heyward", "Micah Parsons", "Darius Leonard", "De'Vondre Campbell")),
    ("Blocker", False, ("Rashawn Slater", "Lane Johnson", "Quenton Nelson", "Wyatt Teller", "Corey Linsley")),
    ("Rusher", False, ("Robert Quinn", "Maxx Crosby", "Chris Jones", "Jeffery Simmons", "Demario Davis", "Roquan Smith", "Bobby Wagner")),
)


def honours_table(spark: SparkSession) -> DataFrame:
    """(role, name, first_team), as `ranking.add_honours` takes it."""
    return spark.createDataFrame([(role, name, first) for role, first, names in HONOURS for name in names], "role string, name string, first_team boolean")
