"""Functions from columns to columns.  All of them stay inside the JVM.

Where the input can be wrong there are two forms: the plain one raises, ``try_*`` gives null or a struct with the error text.
"""
