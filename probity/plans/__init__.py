"""The registered queries and their SQL: text, activity, tables, model checks."""
