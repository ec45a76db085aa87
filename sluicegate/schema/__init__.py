"""Reading, checking and binding of schemas on the driver."""
