"""shelfmark: catalogs of named items over many sites, built and searched with Spark DataFrames."""
