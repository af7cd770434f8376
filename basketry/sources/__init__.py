from basketry.sources.tables import (  # noqa: F401
    RetailTables, Tables, load_catalog, load_files, load_tables, save_catalog, tx_from_tpch, articles_from_tpch, customers_from_tpch,
    exposures_from_events, read_transactions_csv, read_articles_csv,
    read_customers_csv,
)
from basketry.sources.sinks import write_csv, write_json, write_parquet  # noqa: F401,E402
