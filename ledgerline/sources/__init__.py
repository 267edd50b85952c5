"""Reading tables from files, admitting files, and writing results."""
