"""Operators for preparing large training corpora.

Nothing outside this folder imports it; removing it leaves the rest of the
package working.
"""
