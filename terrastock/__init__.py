"""Regional inventories of buildings and roads as Spark DataFrames."""
