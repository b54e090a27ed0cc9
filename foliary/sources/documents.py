"""Files as one object with a method for each thing that is asked of them; every answer is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout, search, spatial
from .pdf import parse, sections


class Documents:
    """A table with a key and the files' bytes. Pages are counted from zero; a range includes both ends."""

    def __init__(self, files: DataFrame, key: str = "path", content: str = "content", password: str = ""):
        self.files = files.select(F.col(key).alias("doc_id"), F.col(content).alias("content"))
        self.password = password

    def section(self, name: str) -> DataFrame:
        """What could be read of a section."""
        return sections(self.files, name, "doc_id", password=self.password).filter("status = 'OK'").drop("status", "error")

    def _pages(self, first: int | None, last: int | None, name: str = "pages") -> DataFrame:
        found = self.section(name)
        if first is None:
            return found
        if first < 0 or last is not None and last < first:
            raise ValueError(f"pages {first} to {last}")
        return found.filter(F.col("page_no").between(first, first if last is None else last))

    def page_count(self) -> DataFrame:
        return self.section("documents").select("doc_id", "n_pages")

    def page_info(self, page: int | None = None) -> DataFrame:
        return self._pages(page, None).select("doc_id", "page_no", "width", "height", "rotate", "crop")

    def metadata(self) -> DataFrame:
        return self.section("documents").select("doc_id", "version", "linearized", "info")

    def text(self, first: int, last: int | None = None) -> DataFrame:
        return layout.range_text(self._pages(first, last), "doc_id", first, first if last is None else last)

    def overview(self, first: int, last: int) -> DataFrame:
        """Page count, facts of the first page of a range, its text, and the number of fonts: from one parse of each file.

        The same rows as ``page_count``, ``page_info``, ``text`` and ``fonts`` joined by document.
        """
        if not 0 <= first <= last:
            raise ValueError(f"pages {first} to {last}")
        read = lambda name: F.filter(name, lambda r: r["status"] == "OK")
        parsed = parse(self.files, ("documents", "pages", "fonts"), "doc_id", password=self.password)
        parsed = parsed.select("doc_id", *[read(n).alias(n) for n in ("documents", "pages", "fonts")])
        held = F.filter("pages", lambda r: r["page_no"].between(first, last))
        info = F.get(F.filter("pages", lambda r: r["page_no"] == first), F.lit(0))
        names = F.array_distinct(F.transform("fonts", lambda r: r["name"]))
        found = parsed.filter((F.size("documents") > 0) & (F.size("fonts") > 0)).select(
            "doc_id", F.get("documents", F.lit(0))["n_pages"].alias("n_pages"), info.alias("i"), layout.joined_pages(held, first).alias("text"), F.size(names).cast("long").alias("n_fonts")
        )
        return found.filter("i is not null").select("doc_id", "n_pages", "i.width", "i.height", "i.rotate", "i.crop", "text", "n_fonts")

    def text_layout(self, page: int | None = None) -> DataFrame:
        return self._pages(page, None, "chars")

    def find_text(self, term: str, page: int | None = None) -> DataFrame:
        """Overlapping occurrences on each page, by offset."""
        keyed = self._pages(page, None).select(F.struct("doc_id", "page_no").alias("doc_id"), "text")
        return search.hits(keyed, term).select("doc_id.*", "start", "context")

    def search_text(self, term: str, first: int | None = None, last: int | None = None, case_sensitive: bool = False, most: int = 0) -> DataFrame:
        """Occurrences in a range of pages, the first ``most`` of each document; zero or less for all."""
        keyed = self._pages(first, last).select(F.struct("doc_id", "page_no").alias("doc_id"), "text")
        found = search.hits(keyed, term, case_sensitive).select("doc_id.*", "start", "context")
        ordered = found.withColumn("start", F.struct("page_no", "start"))
        return search.limit_per_document(ordered, most).withColumn("start", F.col("start.start"))

    def select_text(self, x1: float, y1: float, x2: float, y2: float, page: int | None = None) -> DataFrame:
        return spatial.select_rect(self._pages(page, None, "glyph_pages"), x1, y1, x2, y2)

    def select_range(self, start: int, length: int, page: int | None = None) -> DataFrame:
        """Lines that a range of the page's UTF-8 text touches."""
        return spatial.select_range(layout.byte_index(layout.lines(self._pages(page, None, "glyph_pages"))), start, length)

    def query_region(self, x1: float, y1: float, x2: float, y2: float, page: int | None = None) -> DataFrame:
        """Text of glyphs whose centres lie in a region, line by line."""
        return spatial.select_rect(self._pages(page, None, "glyph_pages"), x1, y1, x2, y2, centre=True)

    def page_structure(self, page: int | None = None) -> DataFrame:
        """Lines with their columns and reading order."""
        return layout.reading_order(layout.columns(layout.lines(self._pages(page, None, "glyph_pages"))))

    def fonts(self) -> DataFrame:
        """By resource name; the first page that has one wins."""
        found = self.section("fonts").groupBy("doc_id", "name").agg(F.min_by(F.struct("page_no", "base_font", "subtype", "embedded"), "page_no").alias("f"))
        return found.select("doc_id", "name", "f.*")

    def images(self, page: int | None = None) -> DataFrame:
        return self._pages(page, None, "images").drop("raw")

    def image_placements(self, page: int | None = None) -> DataFrame:
        return self._pages(page, None, "placements")

    def annotations(self, kind: str | None = None, region: tuple[float, float, float, float] | None = None) -> DataFrame:
        """Annotations, of one kind or that touch a region if asked for."""
        found = self.section("annotations")
        if kind:
            found = found.filter(F.col("type") == kind)
        if region:
            x1, y1, x2, y2 = region
            r = F.col("rect")
            found = found.filter((r[0] <= max(x1, x2)) & (r[2] >= min(x1, x2)) & (r[1] <= max(y1, y2)) & (r[3] >= min(y1, y2)))
        return found
