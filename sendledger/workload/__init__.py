"""Every operator as a runnable query over the sample tables, with its SQL twin."""
