from custlens.sources.shop import Shop
from custlens.sources.csvshop import read_csv_shop, read_table, discover_tables
from custlens.sources.starschema import read_star_shop, read_star_table

__all__ = ["Shop", "read_csv_shop", "read_table", "discover_tables", "read_star_shop", "read_star_table"]
