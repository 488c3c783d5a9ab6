"""Sentences that say why a feature matters."""

from __future__ import annotations

#: The sentence of a statement without features, and of each feature.
STANDARD = "Standard DML with no SQL Server-specific features detected."
SENTENCES = {
    "TOP": "TOP clause translates to PostgreSQL LIMIT with no behavioral change.",
    "ISNULL": "ISNULL translates directly to PostgreSQL COALESCE with no behavioral change.",
    "GETDATE": "GETDATE() translates to PostgreSQL NOW() or CURRENT_TIMESTAMP with no behavioral change.",
    "LEN": "LEN() translates to PostgreSQL LENGTH() with no behavioral change.",
    "CHARINDEX": "CHARINDEX translates to PostgreSQL POSITION() or STRPOS() with no behavioral change.",
    "PATINDEX": "PATINDEX translates to PostgreSQL regexp pattern matching with minor syntax adjustment.",
    "STUFF": "STUFF() translates to PostgreSQL OVERLAY() with minor syntax adjustment.",
    "DATEADD": "DATEADD translates to PostgreSQL interval arithmetic with minor syntax change.",
    "DATEDIFF": "DATEDIFF translates to PostgreSQL date subtraction or EXTRACT with minor refactoring.",
    "DATEPART": "DATEPART translates to PostgreSQL EXTRACT() with minor syntax change.",
    "OFFSET_FETCH": "OFFSET/FETCH translates directly to PostgreSQL LIMIT/OFFSET syntax.",
    "STRING_CONCAT": "String concatenation operator (+) translates to PostgreSQL || operator.",
    "STRING_CONCAT_PLUS": "String concatenation with + operator translates to PostgreSQL || operator.",
    "TOP_WITHOUT_ORDER": "TOP without ORDER BY produces non-deterministic results; add ORDER BY or use LIMIT.",
    "PRINT_STATEMENT": "PRINT has no PostgreSQL equivalent; replace with RAISE NOTICE in PL/pgSQL.",
    "THROW": "THROW translates to PostgreSQL RAISE EXCEPTION with minor syntax change.",
    "IMPLICIT_CONVERSION": "Implicit type conversion may behave differently; add explicit CAST for PostgreSQL.",
    "STRING_SPLIT": "STRING_SPLIT() translates to PostgreSQL string_to_table() or regexp_split_to_table().",
    "TRY_CATCH": "TRY_CATCH block requires restructuring to PostgreSQL BEGIN/EXCEPTION/END pattern.",
    "DYNAMIC_SQL": "Dynamic SQL (EXEC/sp_executesql) requires conversion to PostgreSQL EXECUTE format.",
    "EXPLICIT_TRANSACTION": "Explicit transaction control requires review of PostgreSQL transaction semantics.",
    "SAVEPOINT": "SAVEPOINT usage requires verification of PostgreSQL savepoint behavior differences.",
    "TEMP_TABLE": "Local temp table (#name) translates to PostgreSQL TEMP TABLE but lifecycle rules differ.",
    "OUTPUT": "OUTPUT clause requires conversion to PostgreSQL RETURNING clause with scope differences.",
    "CROSS_APPLY": "CROSS APPLY translates to PostgreSQL LATERAL JOIN with minor syntax adjustment.",
    "OUTER_APPLY": "OUTER APPLY translates to PostgreSQL LEFT JOIN LATERAL with minor syntax adjustment.",
    "JSON_METHOD": "JSON methods require conversion to PostgreSQL json/jsonb operators and functions.",
    "IDENTITY": "IDENTITY columns translate to PostgreSQL GENERATED ALWAYS AS IDENTITY or SERIAL.",
    "CTE": "CTE usage is compatible but recursive CTE syntax differences require validation.",
    "RAISERROR": "RAISERROR requires conversion to PostgreSQL RAISE EXCEPTION with different format syntax.",
    "MERGE": "MERGE statement syntax differs significantly; DELETE branch requires separate handling in PostgreSQL.",
    "TABLE_VALUED_PARAMETER": "Table-valued parameters have no direct equivalent; requires redesign using UNNEST or temp tables.",
    "TABLE_VARIABLE": "Table variables have no PostgreSQL equivalent; requires conversion to temp tables or CTEs.",
    "GLOBAL_TEMP_TABLE": "GLOBAL_TEMP_TABLE (##name) has no PostgreSQL equivalent; architectural redesign required for cross-session state.",
    "NOLOCK": "NOLOCK hint is not supported; read consistency strategy must be reconsidered under MVCC.",
    "ROWLOCK": "ROWLOCK hint is not supported in PostgreSQL; application-level locking redesign required.",
    "UPDLOCK": "UPDLOCK hint is not supported in PostgreSQL; SELECT FOR UPDATE or advisory locks required.",
    "PIVOT": "PIVOT requires conversion to PostgreSQL crosstab() from tablefunc or conditional aggregation.",
    "UNPIVOT": "UNPIVOT requires conversion to PostgreSQL LATERAL with VALUES or unnest() pattern.",
    "OPENJSON": "OPENJSON requires conversion to PostgreSQL jsonb_each()/jsonb_array_elements() functions.",
    "FOR_XML": "FOR XML requires conversion to PostgreSQL json_agg()/xmlagg() or string_agg() functions.",
    "OPENQUERY": "OPENQUERY requires replacement with PostgreSQL foreign data wrappers or application-layer integration.",
    "OPENROWSET": "OPENROWSET requires replacement with PostgreSQL foreign data wrappers or file_fdw.",
    "XML_METHOD": "XML_METHOD usage requires XPath rewrite using PostgreSQL xpath() — no direct equivalent exists.",
    "SQL_CLR": "SQL_CLR assemblies have no PostgreSQL equivalent; requires rewrite as PL/pgSQL or application code.",
    "SERVICE_BROKER": "SERVICE_BROKER has no PostgreSQL equivalent; requires external message queue (e.g., RabbitMQ, SQS).",
    "LINKED_SERVER": "LINKED_SERVER references require replacement with PostgreSQL foreign data wrappers (postgres_fdw).",
    "REPLICATION": "SQL Server replication has no direct equivalent; requires PostgreSQL logical replication or CDC setup.",
    "FILESTREAM": "FILESTREAM has no PostgreSQL equivalent; requires migration to large objects (lo) or external storage.",
    "MEMORY_OPTIMIZED": "Memory-optimized tables have no PostgreSQL equivalent; standard tables with tuning required.",
}
#: Notes of a summary, by the features that call for them, and the note where none does.
NOTES = [
    (["GLOBAL_TEMP_TABLE"], "Global temp table usage requires architectural review before effort can be scoped."),
    (["XML_METHOD", "SQL_CLR"], "XML/CLR features require replacement strategy selection (e.g., native PostgreSQL XML or application-layer migration) before estimates can be narrowed."),
    (["LINKED_SERVER", "OPENQUERY", "OPENROWSET"], "Linked server / OPENQUERY usage requires target connectivity architecture decisions (e.g., foreign data wrappers, ETL, or API integration)."),
]
NO_NOTE = "Low-confidence items require design decisions or architectural review to narrow effort ranges. Conduct spike investigations to move items from low to medium confidence."
