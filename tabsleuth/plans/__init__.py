"""Query catalog: every operator applied to the test tables, with its SQL oracle."""
