"""factloom: selections, rules, joins, graphs and reports over code facts, on Spark DataFrames."""

__version__ = "0.1.0"
