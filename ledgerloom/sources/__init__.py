"""Files into rows: folders of statements, delimited text, spreadsheets."""
