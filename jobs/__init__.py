"""Jobs over the supplied tables; each has a function that takes a session, and a command line that makes one."""
