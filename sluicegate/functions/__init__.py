"""Built-in functions, date-times and scripts, for rows and for columns."""
