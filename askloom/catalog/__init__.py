"""Every operator as a query over the provided tables, each with the SQL that
gives the same rows."""
