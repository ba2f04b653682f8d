"""Jobs made of operators: the event table, the catalog tables, and the registered queries."""
