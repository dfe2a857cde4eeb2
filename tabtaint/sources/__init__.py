"""Sources and sinks: Parquet/CSV/JSON/JDBC/text readers, metadata tables, writers, ledger."""
