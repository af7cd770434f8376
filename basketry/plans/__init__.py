"""Query registry (``queries``) and its independent DuckDB SQL oracle (``oracle_sql``)."""
