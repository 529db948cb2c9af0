"""The library's jobs bound to the derived feeds."""

from functools import cached_property

from turmalina.fixtures.tables import (
    BRAND_ARMS, LAGGED, NETWORK_RULES, WAGES, YEARS, Feeds)
from turmalina.plans import catalogue, competitors, enrolment, geography, labour
from turmalina.plans.panel import build_panel
from turmalina.sources.tables import union_by_name, written


class Jobs:
    def __init__(self, spark, sf_dir):
        self.feeds = Feeds(spark, sf_dir)

    @cached_property
    def municipality(self):
        return written(geography.municipality_dimension(self.feeds.municipality_unit()), "municipality")

    @cached_property
    def territory(self):
        return self.feeds.territory()

    def job_links(self):
        return labour.job_links(self.feeds.job_links_raw(), self.territory,
                                self.municipality, LAGGED)

    def establishments(self):
        return labour.establishments(self.feeds.establishments_raw(), self.territory,
                                     self.municipality, LAGGED)

    def job_flow(self):
        return labour.job_flow(self.feeds.job_flow_raw(), self.territory,
                               self.municipality, YEARS, WAGES)

    def census(self):
        return competitors.census_competitors(
            self.feeds.school_census_raw(), self.territory, self.municipality, BRAND_ARMS)

    def scraped(self):
        return competitors.scraped_competitors(
            self.feeds.competitors_scraped(), self.municipality, NETWORK_RULES, {2002: 2001})

    def benefit(self):
        return labour.family_benefit(self.feeds.benefit_raw(), self.territory,
                                     self.municipality, YEARS)

    def enrolments(self, sparse=False):
        self.feeds.write_sales()
        return enrolment.enrolments(self.feeds.enrolment_cube(sparse), self.municipality)

    def course_occupation(self, modality="CHP"):
        return catalogue.course_occupation(self.feeds.course_catalogue(), modality)

    def panel(self, sparse=False, dedupe=False):
        self.feeds.write_sales()
        return build_panel(
            self.enrolments(sparse), self.establishments(), self.course_occupation(),
            self.job_flow(), self.job_links(), union_by_name(self.census(), self.scraped()),
            self.benefit(), dedupe)
