"""wattloom: smart-meter and weather analytics written as Spark DataFrame plans."""
