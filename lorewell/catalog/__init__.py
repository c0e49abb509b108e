"""The registered queries: every operator bound to the shared tables, with SQL that gives the same rows."""
